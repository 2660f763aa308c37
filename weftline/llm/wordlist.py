"""Whole English words (and some word beginnings), most frequent first.

The lower-case tokens of three letters or more that begin a word in the vocabulary byte_bpe_50k.json, in the order of their merges.
"""

RANKED = """
the and that for you with con was pro are com not from have this can his has but wor all will whe they int out who their more one said your cont which
about were had comp would off res man per other been like dis any app them her there year some when than over also part bec time what new get just
into people pre its rec work she our him only spe acc how after att play could first act comm bet two back under may des most did add inc pol again
know need cons want see even ind these use because now make then every sec inv supp look where years diff should rem rel def right through way don ass
reg very includ imp sub being does down many call dec before well much those such end long think bel own prov set show pres say eff inst ent good
start made hel mon last stud min col mod count fin str point sur used same differe while game sim inter report produ still here world though num ret
ref trans take conf going spec hand between ear against high exp ins help requ found person great sign somet ser run ter follow det find mem ext team
system lead around govern cur cour car law read real support really fact day both serv three wom med exper each che cre rep grou met says during fam
happ char gener cor offic too inf public prog war power few loc different state head poss stat val iss cle expl another child since life develop dep
pass turn resp second disc something comple fil month government without leg dist put quest prot never level art things might effect contro cent allow
belie incre feel result lot fun contin using big ask best opp number must direct open post come seem week far tra pri place form told stand next soc
pur let little hum commun mark information bus invest hard import appro test tri rest full care case less partic list top adv dem home left better
data attack proble beh bro build main including got interest keep eas class var small ide rece polit mov plan percent camp pay unt didn pos process
program name four return called move group bre men cap dri pat current pop always mil women old near free design change chang vis book kill away able
country const order million oper thing why school aff days ann prof health sol already charact friend least prom hist est tell talk until later view
word cost enough give techn par large win important doesn business clear rese equ expect occ kind mean past dev bas organ del perform story season
claim came within line project control air money family making bit police happen vers sit sure appear light water times grow company mar example conc
fore actually ever tax major often human job available record sing news econom following hour sex desc become took having product means hop cho
certain non deal side reason elect official possible hold city sever children once activ night done lim working body whether author proper seen fac
cond course event eng pot intern short orig dam press doing protect thought question several given fund went arg polic meet creat games understand
makes won htt love complete account ident others prob young along according yet members among employ invol low hig likely ant ben rele president
access known early fight sent today market based strong deb problem death social campaign mus saf months viol five stre players success present sugg
particular try suggest priv crit land local aut mult political asked former close pract getting across comb believe toget together individual face
value area writ vot key mom anything experience mind future cut tot video investig net impro connect redu above fre amount either milit anal fail
special black looking fire almost study miss tre community media food comes single half started quick issue else consider taken true trad ago mess
added bad fav similar character reported type targ entire history live trying discuss self room fall isn idea sound someone foc object player rather
service mor nothing provide party exist mag rul house behind however sum applic function front series tem typ opt points below specific previous pret
custom court repl whole treat probably learn version check benef doc deter enc super address vict meas field signific feat common begin bring action
describ indust wanted attempt due shall six step pub himself cop dest stop lab hours create further dou national taking red research break space
recent general hit period everything phys saying cou cult coun include position imm pick compl matter compet cannot init relations bar vol ground
security upd concern white seems announ fig stri sus watch wind itself mass abs pack outside anim pain manag foot third mot evidence threat decl item
represent significant cal simply longer file ener dom upon themselves coming quite difficult woman necess text require military review respons subject
instead issues gen minutes weap code higher page students method policy exec accept words final changes friends respect compan damage neg total needs
agre development age results gun rights running wasn port rate pretty target saw circ works everyone pie rad block walk shows site risk inj chall
began size decision larg jud continue parent easy drug sense energy associ girl request soon host states material moment answ especially norm services
role cred mat log office charg track heart ball personal building increase needed lost became groups wrote prop dead http webs inside wrong statement
film music share release forward stay comput original card cand div favor cases section leave required countries questions prim cell shoot anyone
affect online ability content reve laun indic force sold soft companies article aud rev educ playing held released federal administ interview install
received source serious created cause immedi defin late speak legal weeks model pred exact takes regard opportun price ord problems leaders deep pers
contract relationship base consum potential langu relig link lower fem contact ill mother estab squ provided average exam perfect tou buy shot collect
phot played surpr officials simple industry hands pull round user range private ways veh except terms den performance bill environment exc worth pict
chance speed alleg match stru ste living struct separ response enjoy via member tool offer turned recently blood hope comment arri particip gave
select killed goes coll impact boy felt expected image prevent involved eyes quickly behav led candid earlier focus popular sett various levels road
heard mis users improve father search profess knew loss events billion cover bott areas gets vote nearly included recogn happened hot whose civil suff
respond hon features economic technology option purch lat recomm training effects fast occur website email sens oil influ currently goal scient conv
decided travel mention election phone looks situation hor quality table staff tried addition box lack wide mid board anti dig dro slow path worked pen
engine looked victim property introdu execut color network date extra sle wond reports capital ens command allowed prep capt numbers fair reach broad
couple screen lives prior approach emer built repe rules financial considered brought products visit document conduct completely written draw
published secret sexual thous ess standard arm fell foreign regular increased usually demon dark additional production international race mach huge
town attention terror meeting arrest fear extreme workers directly population cross message nation poll answer carry hear natural dog trade subst
multiple fans sort global achie language tal necessary details sen sil medical und ver receive morning bank sat device safe ple systems assist surv
battle paper growth cast plans parts wall movement practice display sometimes son avoid towards talking correct spent term wants doub forces please
ones immediately deg parents shown conditions stuff reb includes experien announced determin described door changed neigh clean pan club paid attacks
characters alone director load rout finally rac contr exactly nature career latest convers weight note teams hundred streng consist regul lic ten
costs independ normal hom obvious swe star ready implement song interesting giving etc middle remember max yourself demand treatment danger guy
physical related remain couldn refer citiz inn stra easily clos uses ang write leader reading autom legisl designed beaut appears strugg choice
particularly allows difference although relative application aren myself imag dise society frequ poor writing seven starting bud print crim gives cool
thinking save limited meaning nice gas eight feet effort ign opin brain wouldn touch studies center computer investigation increasing store comments
bal doll liber wife laws modern administration opportunity sal powerful claims title esc beyond camer sell appl unf violence compared options
throughout files detail piece named education drive items student throw scene complex prec concept status died knowledge beginning certainly guys
slight fine fat perhaps income https majority greater feed safety unique gone showed histor counter leading send defense yes continued provides prison
happy economy trust weapons analysis science figure disapp software ult officers remains psych cat observ stage enter passed despite movie voice
toward region values mount officer hous lay pressure books reasons activity calls letter choose rob types platform quarter maybe moving lif gold som
patients truth charge cele rock credit moved names straight feature rule sche click aware pattern grad associated style stories individuals summer
arch fully mill followed jobs seemed reality lines park measure brother growing ban estim cry mechan rates positive culture har map altern coach kids
journal corpor false web sleep contain sto bed pun meant notice favorite condition purpose organization challeng manufact susp critic mer mist larger
advant resear actions kept aim benefits actual vehicle chief efforts wait adult overall speech highly female error effective encour failed conserv
programs trou ahead crime location behavior rare emb caused ship active contribut green acqu reflect firm birth clearly emot agency memory biggest rap
basic band suspect spread demonstr absolute places impl cards destroy virt appeared beg temper length blog integ resources spot forced thousands qual
generally drink thus appropri whom eye college ensure apparent religious minor tro primary developed peace skin blue families apply inform limit
resist conflic twe liter hair eventually pus helped agg fit prem sales seconds strength feeling tour knows exerc somew spokes ideas regist propos
launch bottom script rat whatever mode agree sources initial restrict wonder burn nor reached sun categ cook promot male climate fix alleged images
schools drop stream previously pet double default rank weapon stock analy picture century citizens onto expand hero wild update customers lik criminal
leaving otherwise basis recommend floor crowd central dream download confir window happens unit tend spl becomes fighting predict heavy fan spend adop
football transfer bur therefore mission noted assum disease edit progress adding raised tick seeing agreement server wat debate supposed largest
successful jump owners offers shooting effic haven defend beat records scen employees devices commer benefit illeg surface harm shut lose challenge
station intelligence accur requires hospital spirit offered produce creating cris ended daily voters smart circum extremely opinion gain useful budget
comfort background episode enemy trial establish continues showing posted eat rise signed vill grand projects conference responsible learned returned
brief brand highest train nom mut incident nuclear charges adjust earth prices draft runs candidate management teach understanding separate instance
eth unless operations faith config activities traditional direction machine surround push easier argument micro spending theory calling der influence
commit photo unc disp wish revealed enforce chem miles interested solution removed compar plant achieve advantage slightly placed tim cru mostly
negative setting produced mur connection driver executive assault born structure reduce decades ded league join disco die assess goals senior parties
learning street camera skills celebr existing willing critical serve cold species animals older teacher prefer thread manager professional notes fresh
doubt opened guess sequ explain attract string context solid cities asking random depend mentioned claimed definitely core opening believed holding
ice brow authorities score cells transl neighbor remove district worse concerns presidential policies hus independent protection sudden bul strategy
girls missing dat politics spell graph labor kick steps smaller roll researchers closed transport lawy aspect none marriage elements dram hearing
supported testing massive stick guard border copy owner digital task incred breat issued detect partners shared cancer explained heat investment wood
tools belief crisis operation contains express amb finding funding established degree dangerous freedom church catch presence authority button consequ
valid weak starts reference collection beautiful tells waiting providing daughter master purposes equal turns documents watching ran reject victims
witness reform occup caught traffic models served batter agreed truly units variety amazing confirmed entirely purchase element cash determine cars
views drugs department covered mere multi mix unlike stopped sem wel skill becoming appropriate weekend sites animal scale charged instruct methods
cert judge dollars standing debt driving album commercial discovered output abuse switch annual stated democr residents allowing factors fuck occurred
north injury insurance repeated arms construction fle forms mental equipment fant discussion regarding chair proceed murder supply input wealth proced
putting located kid princ clot telling proposed funds baby spoke earn exchange pair arrested killing identified mobile thanks hundreds trend electric
restaur trig nine bomb coverage appeal finished flow deliver calcul photos phil pieces appre rough partner concerned suggested herself corner husband
internet balance sounds arr millions radio satisf combat fuel distance tests decre managed tit measures attend generation advoc conversation gender
concent carried arrived failure minimum worst keeping intended illegal subsc determined trip raise feels package fra symb justice farm reduced clin
hyp san novel capacity impossible plays minister fram ing communities bon strateg interests conflict requirements sac operating committed relatively
south afford identity decisions accused victory seek tight initi humans familiar audience internal sides dim conclud appoint enforcement circumst
joined differences protest twice glass expression decide planning handle maximum sea eval helps bound mouth standards clim army bug planet winning
faster spect broken defined healthy competition announce client possibly finish crew reserv editor hate sale controvers pages numer opposition refuge
flight apart applications gar upgr shape speaking worry hun introduced diet functions stress accounts guarant honest tree sch fif exercise scientists
legislation survey rich maintain flo leadership magic figures absolutely fourth presented alcohol grab vari quant plus alternative pil approx objects
significantly acknow uns negoti television committee motor appearance sitting strike fold belong mort prepared indeed rent advice changing listed
launched lived sets philos applied housing odd sust powers thr remaining causes manner suggests ends gay termin scientific coal sym minute leaves
completed focused monitor vehicles affected construct follows ton homes elim largely votes businesses yards materials guide closer sports taxes decade
vir dropped delay secure treated filed van mir column rot consult entry marijuana apparently increases specifically tele religion frame helping edge
organizations bigger boost row rid stret vision wearing appreci award factor god territ param enemies accident ath forg veter stars expensive acad
lock format soldiers agent responsibility rapid tough believes wear commission warm hasn univers king patient happening bought soul seat revolution
ring offensive returns videos discl famous candidates percentage visual thank trouble prove enh connected possibility expert library fellow dry signs
quiet pure filled unable vast identify prote fish circumstances bodies developing experienced substant domestic combined chemical pool egg hurt
markets conservative supporters agencies temperature conducted pulled fol advance license imagine hell fixed incor surprise craft dial relevant
entered leads pictures alt paying updates greatest height heav listen capable perspect offering bright suppl planned pit sweet typically prospect teen
sched hol scr lots newsp forget severe suit correspond explos flag prin deploy thoughts matters adapt fill forth sam payment spring losing bringing
distribution combination plenty perman tow seeking examples classes beer moves panel properly ris plug estimated defensive pregn instit volume
positions links transform cas opponent tweet shop fly talks bag aid plants attorney begins myster environmental storage marg ske metal ordered
remained loved prompt updated experts walking ancient performed neither manufacture selected mine ultimately explan label syn meat giant adm interpret
evening evil obviously advanced weather symbol sole potentially originally deck stood youth basically involve aircraft confirm messages kit prohib
vulner existence turning desire flat ment neighborhood pointed innov professor expressed session bare diss doctor writer oblig recorded broke orders
motion immigration contrast batt excellent technical tun cloud creation strange auth fort extent rain sample accepted tact fired stands boot
statements versions selling weren experiment retail depart bond reaction resolution react approved replace tack sport chain emergency automatically
route pal banks grew coord subs corporate selection slowly colle attempts findings index shock dynam cart storm essential reasonable subsequ
considering university married illust numerous seriously referred consistent facts accompl revenue passing mal gather optim rub unknown union
opportunities browser reporting sand suddenly surprising somewhat challenges settings experiences cann receiving joint cultural ast bull facing boss
instr increasingly shift streets lie laugh adults customer obtained supporting detailed picked wire sight developers persons sad cup warning boys bird
wal observed zone channel refused suc spokesman acts struggle discrim category realize employee guns thick fairly surve troops agents battery motiv
flu confident empty phen sector excited remote destroyed moral dress lit shouldn sympt carbon installed violent solar practices ride improved audio
behavi eating properties anywhere blow proud plane square proof talked sister holds resident resistance split prosecut confidence cuts exception zero
copyright totally sick household fees drivers necessarily regulations perspective escape surprised vac emphas narr heads causing targets afternoon
adds usual withd articles injured manage explains diagn linked discussed explo occasion opposite faces denied nut approximately disappoint voting
institutions drag nearby guilty conver reward philosoph apps upper advert snow frust ourselves dismiss cere signal crimes council sufficient
historical pin succeed tradition cro description sky widely wave definition cycle refere brings alive frequently intention privacy rail cooper tested
comfortable delivered depth writes assets sav transition artist lob components walked root participants noticed resc nav importance assert injuries
registered intent missed sentence assistance database buildings classic thinks fee effectively facility bear chapter dogs latter admitted posts lawyer
equival mand controlled menu protected administr rein amounts native represents abandon carrying tank declared hat punish universe infrastructure
opposed hardware coffee owned hall describe portion atmosp governments depending offense trick desk movies remark mail conscious ruling medic replaced
renew shots armed constant taste realized buff efficient communication flood consequences anyway iron evolution relationships proposal collabor
knowing supports controls merely athlet fashion gift era kinds legit essentially therap suffered hur promise excess overw prime stores journey
requests consumers tiny isol crash emotional goods elected moder blocks island elections broadcast cheap nations seasons waste fields profile authors
deaths vacc formed ongoing assume coast voted flex welcome locations buying architect harder interface restaurant discover exceed favour duty pitch
responded extended medium magazine limits external younger remind immediate hidden volunte simpl phase plot exposure expansion pushed marketing hits
gro stim narrow perfectly enable precise regime shif compens chosen trees recommended arguments exists bike breaking crazy virtual permission consumer
closely hopes array spons pow readers employment creature resulting accurate moments argued ped sought suffering icon pra bonus acting comparison
smooth sending dealing attached sees typical finds emails highlight confront unus topic ble understood mob dedicated songs tech rape aside grant argue
containing schedule liberal publicly heavily bes everybody femin facilities conven anx division explore shares ideal plastic distinct trading exhib
initially thousand paragraph roughly www creative consumption films obtain tall tor acknowled grown suicide watched surrounding pip flying serving sho
jail literally exposed lies bat earned specified degrees centre sharing winter unw fewer somewhere attacked domain stronger penalty declined neck
fraud currency rising tab talent village legs acid hyd involving yesterday terrorist sup synt west visible struck awesome drawn answers threats defeat
vent rum situations saved recip faced elig mistake symptoms domin falling ending matches explanation anymore letters risks reportedly plate subjects
attempted unlikely veget shel marked spr defe theme passion info shit poly component doctors granted paint honor smoke payments primarily deals
scheduled fundamental protein newspaper clients feedback stretch cock hotel sugar milk approval equivalent insert extension accomp constantly
generated recognize vary patterns profession colors infect phenomen shell puts delivery brown processing lights industrial somehow proport politicians
indicate hole techniques competitive phr campus aspects helpful shield trigger tort personally tag keeps bench gap east recovery profit colon strongly
allegations reporters flash strict parking weird regions intellect finger elev conclusion feelings extensive mixed neuro harass territory successfully
ingred overwhel layer allies bunch normally networks sacr chose opponents regardless franch pref bridge wage radical manip secretary gang decent uncle
investors walls publish generate promote cutting chest drinking collected hoping embr warned instructions gear criticism util counsel reduction
teaching deeply estimates choices permanent fasc tournament mel contained wake reveal processes blind steel carefully gaming houses truck scored occas
sharp afraid scheme decline pushing possession privile teachers yield rig hide colleagues principles loud sin stone taught terrible stuck
implementation wheel champions repeatedly likes bath noise northern magn fab displ ticket murd alongside river tur cable wins upcoming survive
inspired statistics yellow urban quarterback register abilities variable contem thin gotten constit asks tail exciting encourage commitment rally
subsid spin captured innoc allegedly artists electronic regional wra myth directed extract sorry vice wonderful gra ships activists habit inqu
abortion void explicit engaged angry rating frag worried obser apartment estate county disag immigrants folks gall targeted stead informed driven
regularly basket principle stun alert democracy represented diplom capture announcement hook purs refugees recognized hadn pilot returning trail
routine courts desper friendly pled breath studio impressive fing downt fault outcome elsewhere retire pounds communications loan ratio gonna invent
promised dinner creates operate sustain incredible warrant lawsuit reviews featured forever poverty laid filter creatures association valuable liquid
incredibly solutions atmosphere blame respectively fifth governor purchased hack intense origin define careful shoulder tied destruction nobody tip
technique jur legend accord busy hang surgery reprodu uniform scenes crypt recon scream adopted scores indicated entertain twenty engage smile
personnel toler doors tone machines entering forest horse complaint academic fruit wine pursu licens clothes squad stable raw keys complicated absor
funny relief chart drawing module salt resource somebody participate rose muscle consent continuing rear provision liked bra meetings tox convent auto
recording programming pic proved stab caption newly discipl edition passes guest acceler authent armor compat inches assign prepare depends tracks
lists alter condem everywhere affili fought mac scope que enjoyed aggressive recipe rarely subsection southern frequency behalf sequence controversial
comprom worker mainly algorith organized fake concluded chances configuration withdraw fro tries samples bid photograph contest signing exit racial
sword trib inner protocol shipping surveillance apolog fulf luck anticip winner silver unusual crack ties practical province priority describes branch
porn enthus fighters foundation judgment solve neutral advis reputation smell bread claiming genetic technologies upgrade developer unex barely
illness patch butt stupid protests chat wing parliament render bitcoin recover incorpor preced threatened spiritual advertising improvements errors
sensitive cream exclusive comprehens deleg conce remem structures stored temporary tickets possess contracts unp cig mountain equally lands rejected
transaction cos provisions gained directory raising console bom uncertain measured plain seats dict estimate contributed episodes terrorism movements
prev suffer nerv mainstream franchise demands agenda dozen clinical visited actor delic contribute inject listening congress premium assigned
worldwide narrative relation covers certific grass engineering unemploy ven steal replied ultimate titles joy hyper officially difficulty resulted
restrictions beauty maps electricity org burd violation usage permit naturally thrown alien pace poison formal genuine kil procedure trained crucial
lets champion writers connections okay encounter achieved checks assistant whenever clock borrow mad personality gains commonly terr hypot rely tiss
ridic uncom moon vulnerable western occurs vessel discrimination subsequent fantasy testim boat marks ordinary ren representative petition adventure
ignore factory tasks depression cogn eligible reducing striking dollar instrument philosophy ruled scenario enorm debut tea absence ham tables
chairman pump rapidly substantial saving recru assessment dynamic furn propag accommod stack reven brut perpet hardly sty transactions gate screens
submitted languages falls coc strikes deliber relax extrem bell disorder locked emissions shortly rival dust reaching satell stations agric applies
anger compare aimed regulation jury airport sections medicine hitting spark ads foods replacement chicken lowest minds involves arrang procedures
bills improvement inev expectations intellectual spaces mechanism barrel static tips handling journalists comic nomine versus loop surf beliefs setup
brew computers taxp displayed grav fiscal cameras aver requirement entitled shadow elite divided heading copies losses vit ans reporter superior
therapy peak lying gam responses consideration loyal instant extend convicted founder convin scholars overse substance minority manufacturing attended
appreciate guarantee ocean headed tape loose logic proven spir admit investigate requested windows behaviour reader hung roles implemented blank
serves cited repair critics shout fool producing lib rounds circle prepar submit nic vital password publication prominent speaks bars deeper wid
butter smoking indicates adj presum fur polls secondary monster ownership arrive null thro kiss upset corruption hint greatly begun soil maintenance
dozens humanity rom gathered attacking arbit dance baseball contributions literature exha bab container fallen websites bottle breast veteran
interviews banned concerning expenses entity reliable paralle opinions indu compete thorough employed establishment lawyers efficiency mask disaster
ages casual enabled emerged cabin registration fingers roster framework transportation awareness attempting defence scan fucking answered categories
rational cust robot correctly gif graphics grounds distributed sanctions challenging ingredients invited founded bowl brothers wages seed addresses
attitude mole discovery supplies distingu recept vert swim gal interact convinced objective dish downtown tomorrow survival settlement ethnic incent
maintained breaks recognition welf addressed virus whereas papers pleasure acquired duration calm burning folder performing welfare lin enhance notion
cannabis covering citizen phones raid ignored upload modified rooms suggesting clothing heaven stages wedd phrase brill providers silence aer
platforms demonstrated interf races grade bow flavor historic colour viewed intervention diversity periods reverse quote screw landing pill wet
protesters repeat salary mayor kitchen featuring servers anybody finance closing firms embarrass letting threw channels sear fantastic swing sheet
variables spoken loaded footage unl throwing firing tracking width struggling monthly eggs hired stayed stro fabric dates pron basketball lucky
assumed affairs glad joining populations nose complaints scoring mining visitors damaged characteristics flags execution joke testimony obst studied
lad kernel overwhelming aged applicable roads commands offices tut receiver shopping entertainment reads employer involvement anxiety roof stats
constitutional referring tackle backed ele defeated seemingly gene discount clubs sid beings introduction meal ranks collapse opens echo soph racist
enormous waves tap comprehensive farmers proportion designs negotiations virtually warn legitimate convention consistently compensation punishment tie
knife memories angle rend counts educational accessible drew trials preferred bin cow signature retired bytes neighb devast suspected capabilities
revel cheese failing appointed institution expanded monitoring podcast coalition stolen stops holiday intr warming producer accuracy mini overt
membership exch removal adequ teeth emotion perm solely extraord guidelines dying suspended dad abandoned march horror childhood campaigns lunch bone
tonight wars formation compe discussions criteria installation accomplish publisher rescue pocket bene parameters concert shoes visiting recall bub
rural concrete loans trem fate tired principal sevent mood strategic diseases forum tempor headquarters guitar releases disabled unexpected unclear
contrad strategies passage improving reveals decrease annoy cyber photograp sed diverse encouraged conspiracy birds operator handful classified
dramatic investigators widespread collective journalist temperatures guid inspect missile manual simultane ratings suck universal pharm disrupt
statist undert deny provider surviv mistakes node fails shirt waters ease scar contents contribution shr handed stability trave mirror weigh fiction
physically stake demonstrate profits battles drives eastern lawmakers protecting yeah shame attach representing obs incidents viewers mouse clar
accordance bot innocent initiative spots conventional corporations blocked refers buck topics underlying investigating pregnancy touchdown instances
fears remarks mit experiments judges stere participation weekly conversations infection heroes settled strip hal dump les references wanting exclus
gentle lift ranked stadium deadly riding documentation lens gross arrival desert supplement knee margin intake differently bits searching functional
desired circuit minim drove hip pros utility concentration font amid revers interaction jurisd spells civilians entrance convert controversy contrary
arc packages progressive reserved printed centers introduce odds surely independence passengers loves facilit identical doct partnership confused
wrest holes pregnant signals pulling graduate nominee permitted authorized alarm generations dragon controller approached cance formula weakness ramp
brilliant accus homeless organic presentation assembly tong beach rush calculated occasionally bullet hosp promises sne accum terrorists consciousness
drama labour utter democratic assass gest abroad metab sorts flav musical drops gre equality burden vig ceremony fighter actors align elder
representation harassment symp boxes manifest dies missions resolve followers asc silent timing prisoners tower approaches precisely bureau keyboard
funded staying psychological mile wider till accompan flour pleased pointing inflation roy wedding requiring qualified segment sizes corrupt celeb
dreams checking preparing actively lux deputy transgender summary inher knock lip impression celebrate slide guests clip savings captain legacy
wounded pursue oxy semi obsc checked dual centuries evident unemployment intim biological soldier math bias dating mice meters rocket certificate grid
rolling tissue racism mystery examine stem sits hoped dialogue persu chronic parallel scandal carries phenomenon retirement duties dose scroll sauce
landscape coin overs posting fel bold focusing deemed recommendations stepped voter moderate restricted tob cir collaps ought export drunk wise ancest
frequent interpretation dependent coins fatal cooking confusion custody restaurants acknowledged ther genes tactics vend hes noting targeting credits
emotions representatives legislative removing tweeted forcing speaker males concepts voices cul lady arts slot athletes presc tons golden punch enact
lobby mos picking lifetime cognitive dub consists festival intellig dele lapt magical jun imposed astron correl immune courses lean ghost outcomes
expense everyday acceptable equipped orange disappear spawn deserve minimal nervous rook resign affordable hanging implications maintaining guards
derived executed theories quoted tears birthday spectrum architecture recruit monsters destination attractive foss presents reply cum delight affects
donations overcome investigations hunting sessions portray communicate comedy belt predicted importantly remarkable eliminate bind advocates charity
caps fleet recre sleeping designated animation delayed tremend curious lect innovation loading dispute nurs template appearances translation sake
beneath inhib euro studying perceived examined eager coaches imper produces municip girlfriend hire suitable inequ interior analys considerable
forecast fert ballot instantly picks tent civilian inch logo cooperation walks investments imprison legally gri threatening dismissed roots discussing
continu refuse managing synd professionals guidance universities assemb anniversary transit restore explaining asset transferred burst meets
corresponding insisted surrounded tens lane coinc existed skept perception adopt satellite infant tobacco flesh beating gathering cultiv badly
choosing contacted quit distur stir token functionality limitations meth veterans trends wondering separated desp relating enthusi activist mart
explosion insight convenient counterpart overseas pride displays traveling hospitals defendant streaming distribut antib chocolate interrupt
conversion bugs amendment gameplay highlights irre balls demanding awarded regulatory sour fet automatic fer extraordinary sexually desktop orient
ears manufacturers conviction garden satisfied inhab programme stomach coordin holy threshold rhet serial employers bother brands pink landed
producers healthcare dominant destro amended fits fights toxic telephone mysterious witnesses questioned endorse ridiculous prayer scientist
underground subscrib hosts err grants summon suspension guaranteed rice referendum fled shocked partly ignor transmission homosexual hopefully lesson
boards incorrect bacteria snap parad availability wisdom priest span parameter convince safely converted reserve healing inherent integrated pipeline
applying embed cave consensus rewards popularity electron integrity exclusively grace torture burned entreprene gym administrative manufacturer vel
isolated backup promoting commander flee forgotten residence resemb wand meaningful bol helic wealthy rifle expanding receives briefly stimul chip haz
prize associate mild propaganda anonymous struggled outrage leather worlds broader tear proposals iter volunt speakers borders figured simultaneously
charging urged conj documentary tanks lessons outstanding volunteers spray managers camps artificial bags compatible fed argues unfair corn offset
directions disappointed viewing towns layers rolled jumped attribute unnecess suppose buried sixth wound cycl mechanisms congressional agreements
decor closest mixture fluid pist racing cheaper vertical helicop sacrifice violations composition texture smartphone forb defending banking respective
drinks bands grip openly reviewed verify unpre shelter gui suggestions explicitly slave blockchain competing promising soccer constitution distract
accompanied identification invasion industries subtle survived flaw deficit tutorial arguing contemporary integration tum hiding spokesperson emerging
preparation prost suspects autonom dealt steady decreased sovere gradually dirty dil calendar compliance chamber passenger darkness defect packed gods
harsh algorithm oxygen visits blade kilomet killer divine nomination engines cats buffer traff tongue radiation couples physics politically worship
mathemat sentenced disk optional babies seeds thy recovered powder lips designer disorders courage chaos carrier routes engaging unions completion
privilege neur bones titled prosecutors engineer hearts ministry penet bulk preval poster attending licensed blast profound participating anime
specify regarded sons merc experimental comply seized constructed hosted scared bless blocking chips evac corporation lighting neighbors beef occupied
aims dramatically heal painting engineers quantity earnings stance dropping dressed justify prompted scrut speeds describing nowhere instruction
entities inquiry pressed raises outer amongst climb combine compr significance remembered coup terminal tension wings naked density dimin desperate
presidency unlock handled disappeared genre determination acknowledge capitalism painful curve bombs inspiration exhaust descript ritual promotion
toss happiness beta strengthen buttons kicked drone cam preventing retro cruel float filing rib championship styles cake builds epic outs solo
preserve tub bund traged occasional interactions owns hockey logical expend escal stopping excuse operated reaches pollution delete hash shorter horm
prohibited intensity liability neighbour fires revolutionary settle execute spokeswoman lifestyle clicking trailer mountains damn pressing bail pir
thirty electrical demanded backing mothers variation grave interviewed rookie depos ampl peaceful diver mic stating lung criticized vaccine detected
adjusted senator opposing conflicts matching src engagement executives liberty talented consecut horrible surprisingly females mechanical robust
theoret retain deployed subscribe partially crown documented brutal theft tube query publishing wore ric notable subsequently observe codes
residential mas sophistic cens mortality yours occasions recalled vocal bathroom shops collaboration tends torn economics shoulders expecting
examination midfield layout floating tremendous abund similarly conservatives pray tempt emphasis fishing marry reck dispos suspic merch environments
reflects honey analyst gut households ster temple reforms favourite deadline nights invalid wireless hostile ally gig outlets ash abstract adviser
bases courtesy crossing cleared refugee throws disagree reflected embrace appointment placing bicy whis investigated photographs evolved dun hub
encouraging prosecution pants fossil rocks greet filling diabetes firearms accepting resort hunt sustained crossed breakfast attributes vibr touched
damages impressed anch mounted delicious elabor defic constitu confirmation jet processor patri realistic appearing pipe fru awful evaluation
intelligent fundra tweets worn kidn rebels acquisition tradem adverse organisation scratch sensor adoption honestly yard patent bass quietly breathing
pose jew preview unfortunately horn reass peer unto cleaning attracted horr worthy flowers reactions dece indicating preference misc freely muscles
lineup impacts controlling ranking highway incons binding struggles gray comics relatives fright probe voc possibilities qualify libraries migrants
entries consecutive hill inequality cort traits pour missiles essence sends alliance wishes advocate districts influenced challenged barg faculty
acquire insect instruments leaf tale thereby trap strongest flexible kills finishing reduces epid orientation trace laser oppose editing momentum
murdered probability reluct adequate operators modes discipline oral hence overl intimid ranging distant fib wrapped chemicals frozen indirect
uncomfortable consequence bitter countless departure refund seeks mechanics jurisdiction alike resolved cache distinction encount continuous modest
criminals indication encountered ideology hiring pig penalties capability productive balanced afterwards playoffs backs absurd citing trillion
obligation maxim pursuant fract awkward wallet releasing edited accomplished edges planes feeding disclosure grain reasonably drum partial graphic
unprecedented advised fixes caution strings panels leak pricing observations suggestion barrier painted compound bears luxury orbit exempt bust
endless commod revenues furniture casting diplomatic modify innovative bonds coaching modules enhanced proceedings teammates compromise flew
unnecessary doctrine playoff complain beaten golf placement newsletter acted juice decks deleted secrets asylum dys assuming mana subur difficulties
collecting bankrupt composed volt militants particles admin squee creator grabbed nodd rated rotation grasp excessive inventory ecosystem billions
venture defender assumption bite earthqu gifts inevitable structural beneficial compelling coat determining rhetoric boundaries whites harvest laptop
enjoying trips addiction powered cous retrie differ kingdom conclusions transparent infer intrig insane museum reset aggreg carb decides exceptions
legendary tunnel insult troll shake detention subt prospects prol performances href achievement fut projected colleg awards pending instinct
developments altogether steam oldest detection circles donors motivated purchases globe departments sustainable prevented incomp dominated invested
complexity incl ensuring realm athe speculation plaint toy plates devoted slaves pepper quotes ceiling transformation fraction advantages toile
stunning moist texts ugly bio trains temporarily overnight mamm tar expects acceptance radar junior frames observation sentences analysts vague clause
directors evaluate cabinet cler researcher poorly experiencing freed themes nin praise trusted cease dign bombing migration municipal glory revealing
arena uncertainty battlefield cinem listing waited spotted lone transf wash slavery exploring encl wooden bureaucr blend supposedly winds gravity
analyses dumb alternate consumed effectiveness paths enables escaped smiled tendency pars lake fitness hier impose pension polar exercises harmful
printing expertise tragedy divid reign unve amend mutual replacing throat batteries toll addressing pupp equity exped demo fiber divorce slower cub
panic quarters rect treating rats sacred declare delivering tel meta header trapped knocked survivors demonstration dirt assists judicial secured
hosting lifted jer wheels diagnosis nationwide dear obligations grows mandatory suspicious mortgage prosecutor editorial processed flexibility focuses
startup breach bizarre vegetables retreat productivity absent identifying regret promoted eru inbox empire horizont branches metaph mods spirits
earning riders sacrific occupation disg nit nodes hatred theater sophisticated defended besides thoroughly blamed crying singing cute donation
substantially grey keen conclude rou seal weaken cultures laughed slip treatments beast obesity elderly pays complained crop proc explosive meals
imagination annually boyfriend bump surge scenarios competitors organis separately habits measurements accompany gly tang plugin convey curs
approaching arrangement affecting permits useless destroying fascinating electoral transparency volunteer statistical activated trash rings
operational witnessed launching assured binary betray exploration admission avoided celebrated cluster spare enterprise flights regards trucks
contacts uncons immense embod patrol beside viable creep triggered comparable gaining prosper polling shar firearm fence variations pledge cure spy
violated rushed stroke pale tune laboratory nons disability singer traded infring strain seventh syndrome wondered purple journalism rebel invite
cheer bedroom dwell operates motivation predec anarch grateful excitement treasure longest deserves reserves cops artif hypothesis purchasing lovely
divide strictly questioning taxpayers rolls ports magnetic inflamm brush bottles padd devastating compiled medication twelve leaked unity infected
traveled interven bearing zones wounds discretion succeeded iconic screening ministers separation bip beloved counting tablet offence protective
fastest boom clever enters linear comparing purely safer cups gluc attributed dupl precious robots lobb statute prevention thou influential forums
starter citizenship accusations sensitivity summit pedest rubber agricultural cancel inaug contam firmly tier invention translated pizza debug horses
boring hood skip essay ammunition shooter unh supplied generic climbing flip jumping frustration neighborhoods median brains shaped draws altered
recipes skilled behaviors declaration reson bubble imperial feminist accounting connecting rehab meantime physician contributing interactive vag
helmet shipped completing spreading scary frank romantic stabil accurately acute symbols civilization lightning considers venue oven peoples std slee
slic corners laughing nuts liver agrees fundament auction threads lacking celebration silly tatt rage rhyth headlines responding vitamin boots viral
stocks churches denial toug nick makers generous transformed wrap loving arrives heter rental belongs attorneys crops matched dispar buyers ethics
justified marginal respected nodded dash entert knees rug attitudes qualities notification anticipated computing lesser peers technically submission
manually respondents fare receipt jack agriculture skull passive societies reminded interference scrutiny conducting exchanges inhabit twist wherever
jokes highlighted pile prelim felony practically actress visa embedded hybrid earliest sooner steep disadvant exploit necessity dated masses
subscription anonym presumably comed reflection extends forming unders grat concentrations insulin secular whilst winners deliberately sink mandate
gram vacation warnings commentary intu aest reasoning breakdown thrust technological deciding trafficking endors swift metabol enroll repeal
underneath diagnosed shower jihad trauma consolid calories fulfill chains notably deposit affair trop virtue satisfaction lun shook counties
transcript redd alternatives eleph prejud expressions shocking readily planets collapsed irrit buzz accidentally frustrated hungry labels barriers
pairs humor magnitude aging friendship emerge newspapers ambitious cookies sculpt pursuit scripts arrangements diameter loses liqu understands approve
wip ultra intend stays investing believing taxpayer lap drain straw screaming counted damaging ambassador prox arrests prescribed independently fierce
brave suits baseline islands namely arriving quantum funeral turb combo deployment invisible rendering unlocked aqu pad sounded detained daughters
disturbing tast unfortunate attendance parks shifted lighter cod prototype unre gau participated suprem vessels tribe assumptions pound crude swimming
inclusion advances conservation overd awa sidew catast activation unconscious arranged rumors avoiding guilt sail mentally impress intentions
likelihood toys urge occurring stones politician abol refresh arbitrary troubles pilots distribute audit pause rivals fancy crashed tract shed consume
voltage condemned excluded establishing heritage spectacular unst protections macro esp functioning mush puzzle ethical governing restored stressed
seiz permanently neat cord severely interrog triple arise sher flower ate newer meanwhile adjustment divers gamers historically analog longtime
prescription multipl recy quad glob conced capitalist royal blacks spo animated rendered streak clouds discour psychology crystal suspicion relate
vulnerability isolation cooling cocaine mutation cryptoc sisters activate dread propri outdoor sheer gently vegan responsibilities prevents stiff
athletic columns companion packs fart streams shore appeals twin electro statue inspection compassion withdrawal objectives bloody preliminary jacket
dimensions wreck doubled glasses feared touching arguably spat attacker eliminated destruct timeline delegates shapes pione colleges rows spite
assessed lease confidential sealed calculate teenager mock diamond fest switched resume lanes rod variant ward exceptional manages copper exports
portfolio elevated resur monetary fifty confusing praised volumes mature nonprofit passionate descend chrom dancing eleg advocacy priorities thereof
substitute lightly shifts drones workplace resid preferences debates helicopter honour considerably reun condemn tender apt garbage traditions
advertisement archive villages implementing dietary switching velocity cit financing lasted reminder precision designers tragic wield initiatives
joins arrow generating searches randomly batch posed pursuing testified senators analyzed ignoring refusing sweat bay dispro labeled pleasant triumph
aboard incom folk chase teens terrain abused supporter newest admits ende failures infinite continent accommodate pup hammer revised minorities
measurement disable fork implies proteins aggression facilitate illegally academ puzz audiences noble syntax beam origins garage verdict dwar
sentiment wildlife burg recommendation gallery scholar convenience convinc warfare constitute abort martial incoming tolerance flows souls foul genius
limiting varied invented dive expose hacking educated depri incentive oversight tribes licensing specialist cra summar overlook inappropriate
downloaded thumb demonstrates glucose certified relie humanitarian prayers nan renewable distinguish dense editors migr locally lasting handy tensions
formerly ideological sensors dealers defines proceeds proxy sheets chapters millenn dough imagined clinic holder restart orb ram disclose translate
immigrant annoying treaty crowds lbs aggress seam intercept dimension consistency rushing trim shy mentions classroom fortune unle investor
associations provincial unlimited revenge outright fitting formally problematic hazard encryption straightforward pse loyalty lyrics welcomed cooked
monop nurse misleading eternal shifting institutional pant incon donated exhibit tire mobility varying lord vector scrap enabling socialist cargo
farms midnight sheep sponsored charts adjacent tricks manga exagger fruits midst legislature tourists mold drafted substances breed tags verb
manufactured determines utterly sect aluminum zombie satisfy predomin elaborate measuring sir prey installing wrist cotton loads classical desires
autism compact cycles drill colleague maker mistaken whatsoever sells solved sectors horizontal equation trademark makeup assembled saves farming
asleep referen bullets stairs maintains marine acres coordinator counterparts indict chunk cents accordingly eyeb ranges plasma swap athlete
infections corrid vib patches traditionally revelation sweep glance inex leverage correlation repository oun tactical raped algorithms illum fame
introducing delays whistle novels deriv publications aston mate parade maneu waist discont staring alias securities toilet unlaw prest memo galaxy
tooth subjected lineback retailers dangers voluntary interpreted pel careers threaten memor shadows pulls stranger backwards chron theoretical ware
flames cab defining ordering immun persistent hind photography hug subsidies routinely disgust assignment fond intersection dignity commissioner
cartoon scales surveys artwork unch cycling characterized affirm innings aliens cloth digest predictions din aftermath miner clarity pronounced
creators earthquake laying undermin sequel reception sequences outfit delivers blown glim facial greenhouse tokens teenage sued patience aug nest
offseason riot defenders automated penis insist diagram witch recount appreciated doses costly grams wrestling trophy nerve pledged playback
creativity attackers holders transfers colored drown listened appealing disclosed pleaded navigation photographer slice erect hed appet authentic
announcing bod meter workforce renewed organisations compounds envelop supportive averaged lengthy forgot dealer recession desperately hunger sticks
mph intentionally demol debris leap containers commented woods organize maj axis warrior outlined dare searched navigate united flame relies catching
imprisonment pockets closure recruiting apologize lacks tuned infamous celebrity credibility economies headline indef lately incentives resigned
profiles schemes abst ank wished sphere incorporated hated donate lined beans stealing costume sheriff forty intact adapted travelling nicely dried
scal intimate chemistry optimal popul queen analyze dot upgrades cares extending freeze inability organs pretend outlet expressing licenses filters
unfold nutrition founding undermine easiest sexuality fortun surfaces carriers interval frustrating boats suited tom castle evolutionary negotiate
confronted belonging villain accountable portions magazines regulate overview scram loot characteristic trait adaptation archae bikes literary
influences plea pond evaluated obtaining demographic vigil spouse rises potent sparked smiling defendants dishes prolong calculations piv cancelled
grin territories neglig ammo misunder albums pistol interpre beers spacecraft corps prevalence economists pole willingness complement scattered
inmates bleeding queue hij melee digit gem lifting packaging punished jam mapping inevitably vanilla watches leagues initiated recalls ruin melt hem
baking radius fict ink coh spends neurons rall buses adjustments cried meditation ours rankings advers surrender multiplayer heroin optimistic
indicator grocery applicant organizing encounters jewel heating lazy cousin regener nearest achieving anten narc prophe injection inherit medi whoever
por overhead violate heated descriptions achievements eighth specialized newsletters gard immunity implicit surviving rust bees merit mim paste
ignorance basement foster detain neural proves invitation cattle bicycle consultant apology individually disturb entrepreneurs forests twitter acids
compiler donor tribal applicants salaries misconduct eaten favorable stub faithful electronics vacuum tenure sincere progression denying distress
mixing colonial privately unrest premises licence convincing handles hackers customs luc manuscript devil warriors offenders holidays nightmare lever
exhibition alpha enthusiasm wheat correction evangel soup implied sexy republic icons fathers regulated ner bent murders nasty administered genuinely
hydro fines gorge apple rope disappointing cage doubts vendors liberals contractor upside tricky regulators rebell locals physicians hey behavioral
brick conform reviewing insights biology committing atomic preserved prisoner bankruptcy gren exploitation signatures finan meg musicians selecting
examining artic pets impair tablets caut logs mounting unaware dynamics collections successor clone aiming possessed sticking shaking locate fifteen
continuously bypass mast protects artistic sometime shoe shouted concentrated generator clearing ladies dialog inputs poses slots leaks bosses teaches
wears cyl curse psy gaps landlord definitions sufficiently surpass superhero priests definitive secretly locker memorial disgu flavors kicks env
teenagers halt fever satur mall affiliate jar retained limitation refusal accidents imported divisions receptor malicious stepping attraction charter
dining insists configure marketplace refres gates behave endorsed rides flooding risen continually unanim guided succ committees sab pixel pul
contrace coastal wolf sponsor morph runner unbel mud dubbed godd relied celebrating lobbying incomplete restriction incap expectation intens sync
manipulation spear breasts volcan formats parliamentary snake servants prospective bored accessed taxi adventures tribute sketch empower guides
dioxide valued pointer risky absorb refuses bonuses hilar dawn workout philosophical liable overturn factories catches prone matrix login inacc exert
needle notified reminds publishers nort git flies flowing hardest modification crashes urging inhabitants terrifying utilize banner cigarettes senses
practition compile medications fundamentally weaker garlic outbreak economist obstacles placebo discharge destructive dairy collision dont hydrogen
variants indigenous trades remainder swept redist unint fisher vicious reversed shootings filming touchdowns grandfather affection overly supreme
sporting mercy performs tightly demons killings faction undoubtedly underway liv briefing prediction portable presenting justification contractors
proving wives molecules consisting pier nucle gotta mobil verbal monument tile compatibility sadd instructed lethal hormone orche skelet entertaining
minimize undergo constraints cigarette travels lawsuits cryst lowered aerial combinations haun cha vine quantities linking soy recipient socket
solidarity varies une horizon provinces frankly enacted endorsement overtime beats accounted lesbian amendments hopeful spotlight configured troubled
gaze reliability insurg pixels handgun paras categor kinda conjunction dominate nail oath erupt buyer dissent rider illusion inadequ rebuild segments
systematic portal dragged thee barrels comparisons hex anthrop pictured tires classification rejection ranged safegu probable chick imports blew
anytime wholes calculation upgraded appar dice relying profitable slaughter feather deterior stamp flaws shade passport conting observers neglect
skeptical emotionally kicking ladder unacceptable crowded morality fuels cables mankind anchor byte crafted historian towers helm credentials singular
tackles contempt afore nil urgent von offline breathe jumps irrelevant gloves talents palm canon coupled fundraising mathematical sponsors propose
memorable embraced declining spam pitcher caring airline certification empir sensation dism bolt evolve consultation touches faint anxious socially
solving reload pork discourse tournaments violating interfere recreational speeches needing remembers credited bru preceding nonsense smartphones ber
consulting masters suscept wholly suppress concealed happily accepts rivers pussy attain deposits notorious epidemic smallest accessories surplus
ambig chim practicing domains kilometers warranty nost tastes bout switches sourced attachment fitted unlawful authentication stole accountability
albeit submar integer premier blessed legitim disposal gauge induced questionable medal clarify tracked autonomous tenant grim resistant miners misses
graduated angel synchron efficiently transmitted globally piss shelf spont shutdown inconsistent subscribers skeleton inspire angles benchmark
vaccines shine gesture rip oppression conscience incidence mineral thunder opio wasted curric marker extensions offerings defenses vendor contradict
reddit peripher sins administrator pornography tuition catalog suite hike reproductive drought dude relaxed partition participant telesc feas sweeping
lenses matchup credible grandmother thermal subscribing identities reluctant assisted pharmaceutical phosph treats steadily relates clue revision eld
bron mines blanket capac ling carn rifles tourist unveiled predecessor offshore optical stared farther designing mascul casualties aster hotels
considerations couch manipulate synthetic assaulted offenses impe grief opted resignation verse upt aired assumes inferior bundle multip illustrated
tactic dressing duo relent cant scarce candy affiliated sprint junk portrait disputes hipp floors worries settlements mosque finals crushed
sovereignty seller apost amateur dorm consuming armour intensive eliminating advise descent simpler booth mol fist shotgun robbery obscure embassy
militant incarcer generates launches administrators shaft circular freshman bore broadly hills simulation disappointment upward boundary darker
dominance scholarship encourages quo premise rhythm metric transported nod ancestors qualifying mighty explanations fixing declaring anonymity juven
incomes pecul lightweight accent increment complaining midfielder overhaul disproportion demonstrations enrolled cel aide heels broadband marking
wizard ingredient dug farmer lion stain exploded motorcycle particle cholesterol stair oxid desirable theor promotional shortage recruited infants
testosterone deduct distinctive firmware explored factions vide tattoo financially fatigue proceeding miser chairs dent disreg abnormal concess
servant aspir precip recordings proceeded colony stripped potatoes finest crap billionaire sanction logged cricket armies uncovered rebounds mes
nationally inserted governance privileges favorites lover gorgeous slipped veto slim denies distances wanna lemon literal distinguished answering
religions compos youngest altar digging pressures len assassination sovereign depicted dispens ambul hierarchy preseason colours worrying backers
contributor hearings urine strengths logging crews sharply redirect teasp intro malware breeding molecular ain linebacker kin planted dungeon symbolic
filmed diets concludes certainty strangers copied metres deliberate washed improper realise embarrassing verified outline zombies modifications naval
url victories nonetheless injust insufficient negotiating guarantees gambling congr nevertheless presidents poured organizers adul ensures massacre
grades owe backgrounds exhausted clan compromised interrupted twisted fertil unwilling priorit graduates subjective issuing viewer woke depressed
bracket striker neo fleeing stretched revelations alignment blogs clash runtime unwanted scam rack enlight convictions piano circulation backlash
receivers networking lecture uploaded portrayed oversee stealth appreciation basics clips nursing proposition realised allocated smugg hunter fluct
kits uncommon resting pursued assertion shareholders trails satisfying confrontation delicate jaw dull prisons ego spider sampling absorbed bucket
bacter premiere currencies accompanying fatty locks centered throne naming corrected promptly genome cope valley rounded tourism stark blowing unhappy
litigation android integral reiter wonders yields constitutes interim breakthrough prosec sperm dick oct inserting scra runners plun dysfunction
exclusion disgr incorporate reconc nominated writings shallow hast thigh lamb favored cooler glimpse cheek jealous harness disabilities outlook notify
abrupt encrypted forfe rabb foundations compliment adolesc monitors timely contempl positioned posters investigative integrate slides feminism datas
bend airplane publicity commitments aggregate displaying respects restoration illustrate pickup phenomena companions spill bridges insects scare
severity indul norms pulse horrific olive discusses rooted lol commodity libertarian forbidden gran lag mathematics wires critically carbohyd banning
complications bandwidth halfway tales spinning neighbourhood commerce entrepreneur peculiar imagery commem inclined cliff poetry prosperity pills
finale lod backward thri soap foolish righteous coff abuses abusive thereafter prohibition dip ripped inherited bats flawed fog imaging digits arrog
teachings protocols exemption improves intends depict parked judged weights apartments reinforce offender sore authorization notifications sunlight
exclude mesh belonged subway noon coding disl confirms recruitment homicide objection glow verification packet plag shouting ninth energ validity ups
neighboring spine eventual probation romance partisan foreigners testify addict shells sigh patron tropical humble updating calcium competent steering
accommodation aesthetic prince precedent typing arom securing confined swords markers metabolic incumb priced clearance drilling notices bourgeois
vest cookie plausible conception internationally cyn chooses combining radi chess timer tin ordinance accusing noticeable centres lid zoom compression
surg pand socialism guild occurrence fictional crush retrieve stimulus psychiat homosexuality elementary cellular intriguing foam assure congrat
businessman lied sciences connectivity toggle ankle nationalist aggressively hedge pipes blunt remotely refriger tiles rescued comprised manif
prolifer aligned triv coordination termination additions trio projections positively inclusive membr practiced starters intermediate interventions
premature psychiatric indie collar disruption misdem wipe bast belly messaging intuitive discontin unrelated statistically sized caf cared climbed
consisted medieval hacked dire tended legislators redes magnet perceive zip indictment critique advent vowed ski abortions stunned advancing lacked
schizophren elegant conferences canceled trump frequencies meteor hobby sway tide intervals habitat triggers chasing charm blessing textures liquor
resil abundance predictable bullshit emphasized crust primitive enjoyable teammate summoned realizing quicker concentrate responds eligibility pushes
aggrav ruins bans anat grind utilities databases displaced dependencies stimulation associates therape deer repairs receptors remed marriages ballots
hilarious inherently ignorant bounce deceased merge projection java coconut traject imply curiosity heavier deserved phrases yeast reboot metadata
repay suburban atop allocation moisture pine aides underest ceremon tense lovers giants efficacy intest maneuver perfection bang clues vapor fortunate
threatens vet dependency chlor minus cryptocurrency metabolism pestic temp recovering cortex prejudice storms machinery compelled despair vegetable
beds colorful spike margins sympathy workshop burns debts reflecting airst rim weaknesses weighed laughter router hasht hints finishes vintage conqu
wildly lingu protagonist renown motive rockets troubling organisms swall wax dragons acceleration paired interfaces resent artifacts competitor
economically organised enforced varieties abdom altitude professors twins traps weed yoga recipients pools selfish raids satellites lasts unpredict
artillery cruise gel blows proximity enjoys repeating uint processors hurts advisers methodology deton connects contributors brass broker lengths vic
averaging appropriately sandwich coordinate navig goodness brake extremist refined lamp bapt pap commissioned bothered likewise registry ruined
maximize inconven chill starring suppliers serum encomp ambition arrows antenna bool railway tougher washing famously mindset sneak livest landmark
cement thrilled chuck whit viruses theaters unbeliev communist palace sentencing pins siblings prolonged inadequate username battling curriculum soda
sensible wicked dictators similarities hollow hover cad lur hype shoots closes replies intoler proprietary requesting controllers expans oils printer
topped decreases specifications freel dilig decentral plugins fucked cleans boil nurses exceeded extremists traces comr masks sci regression advisor
siege reductions statutory removes puck bee salad promotions expenditure delighted carpet jungle bullying referenced introduces chopped neutrality
investigator shelves unconstitutional reproduction merchant metrics explosives bodily thickness predominantly monitored visibility queries genocide
studios embry corridor cleaned enrollment impacted disastrous indirectly dod amp prohibit educate detective stagger obese bree blades lawful appetite
tennis offspring jets structured aforementioned scaling stew curb genetically umb cohort merchandise imposing offences miracle snapped foes
extensively cater recommends rigid certificates surveyed downward prints colonies spoil advisory specification shirts trivial mentioning supplements
supervision wit cooldown plaintiff afterward stretching inflammation lining freezing inspiring sue exterior nutrients finances specially excerpt
recognised vom notebook durable forgive personalities elevator warehouse illustration atmospheric arche rewarded internally elephant bipartisan slowed
override cripp originated overwhelmed foremost reps lending sworn shuttle hometown persuade combines vivid encoding salvation budgets honored python
blink unemployed clashes directing punct shark jeans embark seize upwards exotic suburbs mint suffers herb fragile flooded owed whisk sudo promotes
sodium correspondent identifies lou coincidence militia infiltr pitching sadly admire embarrassed tubes beautifully decisive clerk caffe wiped reim
imprisoned develops modeling shields lawn cardiovascular demonstrating parse euros glorious conditioning helpless microsc stakes unequ damp apparatus
counters induce slam persist imminent shred phases arose superf endure keyword yarn pathway censorship instructor toe balloon swear gloss remarkably
validation cannon cautious fetch remedy scent beard patents unjust potato forthcoming chef pads onset squeeze prefix epit extracted strains tops poem
uncon slept underwater historians synthesis frog vibrant subord cooperate greeted jazz intox supervisor tours culp pleas illustrates highlighting
exposing irony adapter unm corpse celebrities hormones feeds defeating emphasize collectively mentality downloads surroundings flagship indicators
grapp sights capita voiced expired unstable quests handler versatile conceal obsessed cracked slammed glowing tissues cher bacon irregular intentional
compensate conventions ecc dependence niche bark disadvantage gasoline feud theatre minors trunk capturing exempl clinics substit payload fragments
passwords gospel tenants blat empathy rede smoothly elimination crypto respir reminis utilized hunters visitor hips knocking til casino motives regain
weekends stabbed exploited preparations endeav informational plots hurting academy retailer arising rebellion blonde instrumental retention
therapeutic seas infantry prompting bitch stems thesis kings clay evolving recognizes graduation fertility boxing gluten idol conceived unchanged
depths empirical transm unsafe mechanic smoked slowing lav cheating discovering pencil closet myst minerals musician permissions griev asserted
affidav seated paintings inning census travelled simplicity overlooked monkey overwhelmingly turnout onion crafting arrange alerts gases frost
lowering acclaim startups guardian merits awake parental exceeds idle traders connector overlap cleaner lungs cite pitched trophies attendees spatial
prizes showcase fusion soundtrack princess limbs lonely cores booked administer equals observing virgin brewing merchants divor metals sums envision
granting socio selective furious responsive charitable leaning violates poet resolutions nickname deaf recognise entirety seasonal microphone grains
governed postp undocumented fox assaults assessments downs superb taxation smiles undertaken exh enthusiastic twent governmental autonomy prevalent
nicotine awaiting deputies diesel inaccurate showc plaintiffs privat premiums tam elites definite sighed evenly mailing crashing juvenile reactor
kidney policing tolerate biased privileged beasts comeback extinction transmit doubles disputed injustice counseling objections gast plac unused
temporal therm david systemic scanning understandable canvas angels weighing astonishing opener trainer surgical adjusting frown suspend obstacle
liberties uranium arous theirs downloading discern hath unpleasant screenshot allied monopoly atom cancell cinema duck signaling laughs forwards
reckless listeners vastly knight rude arises realities rode strive anecd shorts hypothes coordinated susceptible shrink ion cough lend positioning
lottery fade bronze boasts emergence akin stip exchanged reservoir standpoint initiate decay brewery terribly mortal revis confess submissions laund
renowned terrified warns pert unsure styl panc dictionary foe jailed maternal unsigned pastor informal yelling drastically eject neut thrive possesses
incarn founders brightness whale echoed goddess eleven paradox hurd offended evaluating tomb payroll extraction supernatural ideals humili liberation
stuffed mosqu campaigning occupy physic puls venues lust appealed omn obsession sliding disappro voluntarily prophet bounds crore columnist seekers
nostalg newcom detrim autop academics idiot teaspoon populated pigs sympathetic marathon seizure dop los subsidiary mirrors ket neurolog cav tumor
clearer stereotypes dur negotiated flown disappearance grabs pedestrian jersey mentor morally obey antibiotics marsh misdemeanor animations
intercourse territorial archives commanded pitches ratios accumulated gentleman penn aka intervene succession separat correspondence shiny sulf
miserable dedication specialists defects jeopard lear ambitions preservation ashamed resemble enrich playable harmony poisoning tortured balancing
acquiring aura intrins camping tapped caffeine boo apples welcoming applaud austerity sucks tabs backpack gifted chin omitted negatively accessing
ambulance headphones borrowed aviation stall uniforms rallies gangs vault designation wells constituents heck cows commanders differential valve brace
perspectives intric peas tossed unfamiliar relieved airports freak firefighters authoritarian browsers unb poke covert contributes contention consoles
chromos visually jewelry delegation accelerate slope indoor hugely tunnels fined directive forehead skate recognizing overweight sounding locking
excav elbow handsome adequately strips crackdown marvel passages thoughtful prostitution ballistic admitting bitcoins fairness supplier catastrophic
endangered destiny cheat unified suppression analyzing squat figuring coordinates chunks subp wiki legitimacy dental deficits contamination confisc
ruler feminists rabbit glue volatile shining foll impaired supers clutch prolet yelled situated annex automation linem wilderness mainland secrecy
punk handing journals congest schizophrenia misogyn reacted plural plum bargain grounded disse atroc minions ori expedition explode extr hardcore dile
vaccination contests fren disconnect persecution healthier cob specialty gru cooperative celebrations unreal partnerships adopting splash envelope
wherein telev myths rigorous communicating observer rehe apologized expenditures hesitate unpredictable renewal postseason exacerb betting elevation
redund reproduce bog popped incompet tyr masturb geometry trajectory distracted foo rugby respiratory triangle undergraduate rightly referee lucrative
unauthorized resembles pathways endurance stint collector dots nationals whip learns detailing broadcasting baked geographic judging storyline burnt
pave campuses mutations captures compares badge erad strap proudly fried withdrawn annotation happier staffers activism perf alright commence opioid
indo legalization tasked tsp refreshing infringement rotate storing warrants judgement outrageous relevance terminated dessert fulfilled prosecuted
migrant cultivation metaphor recruits enthusiasts frightening owning dislike knives loudly warmth topp gunman emperor waking comedian believers
paperwork lev lament pouring cruelty tread modifier imperfect clusters inauguration embodiment overr explosions incorrectly earnest pilgr sleeve hears
browsing homeland haw diving bargaining delegate stagn adam suburb converting chambers amino madness ultr wolves cracks accidental initialized unnamed
noun hostage unrel atoms purported gallons sorted heights traced undergoing sacks proportions halluc warmer grabbing realization enchant abundant
civic vow reper penetration axe shattered vinyl obliged davidjl hurry voy hopeless wary notor occupations possessions inviting predators accelerated
transplant screenshots travelers sensory charming enjoyment compilation copying disciples exceeding smashed conceptual grap nails procure confirming
engineered hooked disgusting kidnapped hacker creepy drawings cyclists optimized staged incapable rewarding contracted sticky tomat nitrogen duplicate
intra dock outreach mammals snaps dos incurred cube runway survivor mushrooms crisp developmental paradigm chaotic bacterial commits cosmic mega vain
carved cites diminished acknowledges microw seniors whereby unavailable slated grammar headset cursor excluding feasible pac polite staggering superst
paran specifics heroic incumbent crunch scoop blogger sellers medicines outward inquiries psychologist contaminated branded paragraphs mins correlated
impart milestone undercover marched ruth feminine sham prestigious sung outdated perceptions deficiency retrospect diagnostic harmless rogue transc
hostility discomfort imperative statewide symm loops autumn shaping quot cherry ost rebound shelters insisting penal dialect spiral quarterbacks hull
google todd spying terminate protesting uncover boycott realizes pretending framed descended rehabilitation borrowing blur translates erupted
successes plague gems stretches storytelling traction ineffective tapes analytics programmes behold sack housed unusually executing editions smarter
outlaw vanished philosopher evacuated visas reinforced screws oceans brakes hello ore terrific tones curves inflammatory batting unpop riots orgasm
constructor antagon theat deeds grassroots surfaced shades neighbours advertis merged gad anticipate slogan disrespect subpoen waiver vulnerabilities
fills cumulative friction scans performers bidding leaned callback accustomed freedoms lump worm newborn fantas sympath ubiqu outputs allev prag
favors burial nurt unlocks conquer elf electorate kindness helicopters criticised polished recons doi barred slap empt hats cans surgeon randomized
proclaim toes ample preserving disbel silk enterprises affidavit advertised hashtag vampire forensic navy vacant hallway facebook matt hurricane skirt
analogy tomatoes appointments masc alley charities undo destinations destined implements optimization kilometres cmd impairment unsuccessful swiftly
nutritional bloc wholesale neglected launcher announcements rotating rests templates replaces illnesses schedules heterosexual herein coerc decreasing
deportation weighs joints simplest lore reservation sou sanctuary vegetarian anticipation enduring departed sidewalk prohibits compute bomber
distraction endured practitioners disturbed drank surprises subparagraph gratitude skies champ agreeing messy devote dumped accumulation smokers
inspector researching cloak multitude reliance artifact alarming reflex weakened costumes uniquely sorrow mansion salv undis branding inheritance
packing regulator contested unpopular stacked yearly stare assessing beverages competitions strengthening melted bounty declares customize composite
contender insign disasters judgments variance melting syrup innocence fal continuity unsupported institute fragment bishop crosses mitigate tomato
stumbled differs ignores tant relay bisexual confession dement hyster drift expire unpaid unarmed illicit smash sting truths sober usable stacks
northeast domination programmer backyard detectives looph gateway doomed slices emailed renov optimism exile railroad replicate comfortably rav
telescope honesty richest outdoors halls contend submitting naive poised socks discoveries puzzles ceased boiling discrep deduction arsenal posing
theology allegation indefinitely commodities brig tenth invoked caucus ounces buddy iteration livestock wasting wishing tapping nationalism squares
append stubborn tearing accuse torrent declines negotiation roller inexpensive wors vul unbelievable nause entr bush paused scout lith circulating
wandering sophomore queer padding folders meaningless candidacy whistlebl cigar hid posture hiking salmon metro bilateral celebrates releg pseudo
attribut tuning cocktail spoon brutality unite microbi amazed falsely distributions pod epidem heap anthem reapp concurrent homemade chassis merger
laps debated silently restraint formidable sacrifices dwarf tangible representations thirst corp gestures packets fraudulent criticize blaming slash
proposing whales therapist subset leisure culmin memoir folded sexist readings embarrassment continuation duel evacuation disposition bolts insurers
retaliation misery unreasonable genital onions conceded forc cries homeowners stitch statistic headers motors hates heel annot footprint seizures
reservations saturated biblical trolls drums cush disciplinary sixty pund springs conve qualifications verses narciss interrogation alleges lakes
worthwhile crystals comprehend flush absorption frightened buys bucks appell listener replay decorated sunk seating employs gigantic towel latency kne
upheld playground mant stereo northwest exceptionally rays recurring upright abduct goodbye alphabet courtroom diplomats barbar maturity instability
fasting acquaint armored philosophers myriad comrades remembering corresponds programmers olig coherent jugg semester dodge faded statutes legends
headache circuits cylinder conflicting slightest forged blo rulers huh submarine allowance crushing advocating sexism caller fueled reminiscent obsess
uphold beverage oscill poles gradual exting liking synthes pains interacting rumor spelling extingu remarked methane imagin wrongdoing bigot
demonstrators membrane benefic magnificent detainees whispered awe physiological limb manipulated bubbles pseud hydra stellar mans dragging ecological
gent benefited polyg prow reconstruction wast psychic solicit sys influx proliferation taxable disregard escaping ginger withstand devastated injected
turnover irrational reef bankers criticisms nood distortion tasty divorced traumatic sabot renamed seaf seldom boolean refrain shutting utilizing
attracting hers discarded mug cursed subreddit crus installment glac acet successive circumstance guessed perpetrators handc kidnapping barn needles
advertisements vou exhibited cancers prud nas atheist balances landsc petty excellence translations parcel ambient villains taller leaking polish
infectious bureaucracy hypocr pitchers guessing villagers specs invari glut impulse honors jurisdictions pear singles cues underwent exaggerated
dubious flashing sadness ironic unaff perimeter spontaneous downside descendants orn radically liabilities meme fingerprint undertake hypothetical
charism admissions exercising vocals litter variability eats elephants strat settlers inadvert nerves mitochond compressed tweak pinch cancellation
focal demise cracking collaborative explores herbs configurations sanct degener deepest screamed nap primaries filtering assemble punched innovations
func fracking settling adolescents rebuilding transforming parole harbor booking emerges trailing versa greed gardens contingent diplomacy upgrading
elic relentless punches foil implementations await umbrella foresee circumcision peripheral withdrew radioactive boarding overthrow motions thankful
predicting killers incub proclaimed packaged heightened stamps persuaded ensl solitary possessing evid blues extremism lunar clown festivals
consequently someday touring beaches purity emission chord elemental annoyed fairy skeletons pupils urgency councill lifes confessed harmon staple
swinging restoring haul futures strategist lateral sor coil sucked rapper tendencies browse overc beet mum typed discounts dismissal averages
allegiance commentators pharmac stainless tan countryside pinned crises standardized patrons spice mourn laundry equip issu systematically contra
rationale carriage peaks contradiction props namespace cove wool presumed hamm stunt smells cockpit oppressed commanding fridge inh clicks rituals
captive ounce disagreement slog exercised solic rainfall devotion robotic assignments vocabulary caval suppressed warp statues advocated peril hatch
lifelong cheeks numbered kissing waving insider violently skepticism genetics onboard pirate mythology eclipse skins glyph regimes photographed
unexpectedly impressions supremacy sang aggravated abruptly excuses costing ghosts reimburse thief recycling lectures nep maid oriented respectful
decree acknowledging hoax aunt distributing extrad stationed undertaking chickens stimuli prepares delta vicinity workshops accusation histories neon
baff symptom banana praying embracing daylight clergy southeast alcoholic proposes calculating stimulate splitting domest forgiveness periodically
arbitration snakes blasted mysteries revive orphan specifies fireworks prosecute acoustic amuse cer cardiac fuzz bites hazardous brighter bolster
antit visions inline inconsist lig alleging forecasts spiders facto bombers homework corro stakeholders transferring tac interpretations upstairs
vagina ingest sandwic immortal flipped sniper converts installations lure narrowly grenade underwear chased parenting anarchist obj fulfilling puppy
entit shooters richer tempted tore assurance whichever fury universally oak workload deprived casts affiliation lact airlines notions transcend spinal
defaults prefers tiger pity compartment corrections dopamine roomm speculate restrictive rampant lent vandal narratives authenticity thanked betrayed
southwest keywords ethnicity widget pasta billing trilogy sniff nephew princip dissolved contexts totals organizer uprising goalkeeper steak solemn
popping adhere unin recol mimic predicts deception learnt diary conditional relic invoke cellphone speeding tackling nude majors logistics weighted
sickness dividends enz meanings penny stern lar backdrop debuted regulating pops commenting rivalry orc bean rented forefront yielded marching reside
torque exams ransom sunset organism cla chorus denounced biography ferry supermarket nominees dictatorship announces deity monarch invaded kidding
tray photographers discharged evangelical interchange filmmaker wrath projectile employing indications args tilt modular assisting redeem worsh
decentralized arrays accomplishments mutually obstruct misrepresent knowingly obsolete bait enlarg reconsider fost stirring medd triggering screams
causal awaken dispatched organizational dilemma hooks validate potion claw burgl quir durability bombings culprit enforcing reprint sinister burger
vinegar prevailing collects quantitative horrors lays nightclub bride revival softly zoo electrom planting swallow laptops peanut lobbyists resisted
outwe retaining poorer weld thieves broadcaster airstrikes pedal collectors dictator dir ssh drunken cornerback skipped haunted stigma monkeys
prostate unden gamer segregation drills spur cafe imaginary guiding swings nud begging strongh rejecting pedestrians concessions beams fibers
instincts coating corpses communal energetic nowadays dwelling tally coward generals horns circulated robbed harassed inhibit composer spreads
suicidal noises saga theoretically similarity sliced anth imped menus undead fonts sustainability flick razor wording populist criticizing muse
cardboard kindly fringe governors timeout redemption waved astronauts swamp candle tonnes ray spun fearful caus pope inaugural gle watchdog balcon
gallon doubling implication doctr malt recap turkey societal commercially spicy superiority consulted listings slew hottest rocky massage paraly pony
cartridge snack mater snipp jointly pumping goat coron anomal sculpture scheduling eyebrows curved sentiments drafting nominal constructive corrupted
almond feast checkpoint transcription tweaks relieve performer turmoil fluor decom tasting distorted agon lan reliably glor adren microwave simplified
inflicted takeover yourselves muscular ingen cruc crate unidentified acclaimed slain dismant dataset palette planetary hailed enumer exploits drastic
architectural wrapping widow temples scouting louder beforehand builder derive poker ambiguous lifts cyt ribs proportional pertaining reiterated owing
essays burdens illustrations xen redesign reversal sinking gum footsteps prose overturned contentious pointless deposited preceded flatt councils
stressful resh wheelchair optimize peek oneself transitions laundering workouts spikes dinosaurs discriminatory vein arcade cubic unofficial rainbow
incarceration syll antiqu factual highways glam dividing births derivative therein separating ratt municipality monk scrub operatives constituted
protested floods cosmetic rooft antidepress incompatible opera generators savage metallic expelled residency dresses geek cemetery crawl pardon
strengthened visuals bash poorest excel aspirations ceremonies intimidation trademarks sob pairing overdose revolt verge invasive profoundly lest
shrinking errone chees hinted contacting labeling mercury expires destabil feathers steer programmed sleeves bully compress awhile calib sponsorship
identifier yog cleanup vibe outlines deported centr injunction sacrificed freelance evidently retains finite repaired periodic championships asteroid
expressly scaled geographical elastic discovers telecommunications scanner enlarge sharks psychedel snapshot pesticides degradation disguise biom
equations hazards virtues elders enhancing combust concussion contraception expresses aux exhibits expands reconciliation pirates purse discourage
spectacle wraps impending screwed encouragement confuse knights discard bishops masculine fatally surrog resurrection nutrient depicting sprink muff
specimens dissatisf tailored holdings nec frontier pensions joked rails emit slate smug spit restruct regeneration energies ger resurrect presently
boosting pics embro craz stove heavens herd fundraiser proponents jelly monks advancement fetal outfits staircase customized mapped methyl approximate
doom crossover standalone invites graveyard escort predecessors hay enzyme fec outspoken zeal disgrace outraged recreation pedoph fallout
presentations html rubbing humidity respectable thriving dracon sticker sunny husbands malf molecule tug cone catastrophe communism halted wander craw
simulations menstru casually certs slid toast fortunes fals fiery atrocities justices insults shaken persona experimenting graphical whopping
advertisers bids destroys undersc ants glanced indicted miscon abide capsule undes citation dictate quarterly geography utmost disagreed dementia labs
ubiquitous consolidated creamy insulting sucking collateral plagued sixteen comprising srf automobile procedural disappears daring podium unhealthy
mund pyramid kissed dreamed greatness spices metropolitan compuls swallowed genres dispatch aven mates recharge galaxies affirmative tutorials fats
rab unic eve adulthood sectarian checkout martyr chilling congestion boast chap examines startling torch professionally clo steals sturdy medals
filings multinational feder worthless pest gays borne percentages potions rang peninsula unanimous lenders hangs franchises isolate disruptive
stitches supplying turret brackets noticing afforded tha obstruction orchestr delet militar unleashed adjustable caliber motivations pent philanthrop
dehyd toxicity retali massively carcin routing waived covenant relaxing quart guarded outgoing rewrite phenomenal longevity impat odor militias
tolerated surreal resemblance carbohydrate accessory toughest funnel condemnation wired selections highs crafts reclaim looming beneficiaries pact
hemp youths endeavor hippocamp dinosaur calculator restricting weekday shrugged bald touted diplomat repression constituency bulb resumed fabulous
amusing orthodox questionnaire penetrate filmmakers stamped thirteen outfield forwarded appra aided unfocused rejects leftist prophecy forge intrinsic
wont famed registering fascist implicated unanimously keeper addicted helmets antioxid waits minion dreaming unfor nested tying cue clicked expiration
blessings addictive rents tipped hierarch wavelength tet quoting communicated inmate erected unim claws superstar sket perks affinity openings
discriminate grinding asthma registers creations lithium applause scandals bake vegetation flux clarified mortg disclaim induction infl atheists ether
weaponry derivatives snacks churn capped duct sailing ted reactors choke admiration swung rash trainers harmed mushroom gentlemen lingering graffiti
quint payable depicts enclosed enactment mouths stranded enhancement healed concerts stickers termed grandparents thrill substantive stray repetitive
qualification simulated unsc summons disconnected erase uncont alerted operative negligence supra prevail belts tighter inactive exponent heir
currents arist breeze pronoun deed oft inflict punishing subsidy deferred shipment alle scrolling scanned torso imperson pissed supervised adolescent
attained miniature innate tempo provocative turtle fluids cousins gears upstream disproportionately undefined electrons commemor irresponsible lime
confinement calorie differing intricate ranch differentiate fortress interception rept remake dared debugging graphs bun pillow progressed obedience
rehears herald repent pleasing shortages jurors wow tsun comprises spies precinct urges timed stripes yen discrete monuments homelessness commentator
racially ethanol parish deviation recess lymph dra loosely interpreter bigotry grenades mandated lava cynical congregation ferv disappearing arrogant
abbre extinct executable resentment comprise interceptions prolific bricks rud laud revived damned patriarch cheapest deprivation opposes plummet
suing pronounce resisting yell induct personalized viewpoint existential evapor aisle reflective entitlement devised winding accessibility textbook
slider grandchildren cerv eternity tweeting speculative pivotal upl classmates blatant lakh sar adorable spawned implant pumps centralized freshly
outsiders ripe classics retiring dealings punching stal exported numerical trending altering temptation prestige barr resides indec perpetual
worldview filtered ensu vitamins ribbon sincerely eighteen contradictory glaring expectancy conspir monstrous handic pumped indicative rapp avail
twentieth valuation affiliates enzymes imprint installer speculated defer inspectors informing glove authorize contracting attractions multiply
equilibrium fourteen misuse abusing ancestry worms thicker peasants vind conquest mocked cinnamon avoidance incarnation tasted terminology directories
bob preferably glitch surrendered testament pathetic whiskey fixture bets flashes masked computed defeats tariffs mage inadvertently stereotyp curl
frameworks flavour permitting murderer rested owes comparative neighbouring biases gunfire pervasive unsett turbo thats perme intimidating eccentric
simulate shipments seasoned experimentation fronts unatt erosion earns accomplishment irrig conquered asserts manipulating transcripts plotting
betrayal displacement royalty municipalities canal resonance hereby shareholder strangely admired plight bachelor unman automotive sidelines slick
ping shortcut bursts clamp mish sorting patriot correctness detrimental stabbing poisoned fountain rains headaches landsl hops exploiting hypocrisy
gunshot wed amen marketed escalation curtain counterfe contenders filename resembling staging wiring strokes policymakers assistants deport influenza
skinny incremental dome losers dens retrieved architects ethic simultaneous dizz smuggling stockp disclosures coral ruthless ensuing congressman
believer unspecified knowledgeable straps turf marital flock treasures modeled pioneer provoked breeds brink rumored unseen garnered tattoos
hesitation therapies consultants residual remedies adaptive wallets slipping alliances orth drying vaguely pneum rubble dst bots brethren logos gobl
subdivision pawn squeezed morale knot divisive boosted newcomers scouts nineteenth empowered psychopath anarchists deploying staffer discounted ante
repetition parody lively pits pens eyel joking inval creditors ceasefire seals tresp immensely cheering drained floated superv mystical enhancements
jerk stalled cryptocurrencies lumin financed tid collusion pediatric neatly sandwiches tucked balcony earthquakes hefty specializes stresses sender
misunderstanding epile provoke dismay donating conveniently tents partnered objected attributable repeats inert artific appliances nationality asshole
notch intercepted continental swelling tempting overseeing mun alterations havoc disciplines notoriously silicon tremb mortar sparse inward antibiotic
elusive assail diminish disbelief blasts undergone grill filesystem clocks wrapper folding ashes accumulate whim repo incorporating bailout linguistic
disinteg cinematic neoc boiled receipts disposed notwithstanding unreliable bloom mediocre tram shakes manifesto satisfactory shores computation
assertions gravitational throttle tyranny robber shrine nucleus sailors ell chancellor amounted tracker maritime ecosystems graduating climax bury
conspic escorted brutally pillar reminding flashed swipe graves shrimp analytical tablespoons researched disrupted jour replica cartoons swarm rebuilt
collaborate raging nar demographics distrust pumpkin regrets fatalities puppet rewritten fascinated vectors tribunal renders espionage summ ditch
spreadsheet mutant dye initiation punishable thinner intermedi eagerly vaginal predator disparity amph outskirts skeletal issuance exits wre hourly
fantasies disob demolition enlisted misguided ensured discouraged flank cess reacts calmly bleed amusement scept sprawling apprehend backend evidenced
chiefs corrobor dumping neurological terminals flare encoded autopsy exemptions drafts lame spouses implying loser vigilant impeachment augmented
unintended recognizable coated lieutenant ideally simplify pleading unravel icy paranoid passer inspections shoppers informative supplementation venom
reunion muc geop corros replication inflic gloom undermining advising overflow gor echoes impuls async mirac pivot bloggers verte prohibiting omin
hateful asymm informs medicinal reaff thighs markings debunk mortgages mash diarr consciously dashboard millennials invade commissions broadcasts
frontal crank rumours steril booster invaluable unintention scrutin gigg engulf proletariat hacks telecom lifespan blasp judiciary baggage remnants
recoil passions tee abolition pillars livelihood roasted dividend knit daunting disturbance shale cultivated refrigerator commercials thinkers chop
suspicions tagged stylish tails seism cowork forcibly thyroid polymer bliss pinpoint labelled bart estrogen visibly outsider dissemin dishonest
manifestation chore sanctioned culturally theological strut constructing vitro lam garment intermitt npm ordeal plugged timber cass surpassed
parallels veil readiness modifying marble infrared auditor executions formations dominating disciplined vengeance landlords piercing congreg scorer
nickel rejo masterpiece inhabited arter plur mastery longstanding wines televised enclosure prophets uneven dwind insistence hardship plead reviewers
cured whipped bouncing cannabin coats prowess plainly freight inhibition clam psycho treaties indisc resilient slack mundane establishes strained nond
caste unfairly parser furnished outset metic hides educators volatility toddler grape splits peasant reneg trek realism oxide mounts biting collapsing
postal museums detached respecting monopol workflow persistence redundant bending revoked offending framing printf construed coded chast coffin
securely inception psychologists cakes pundits hitter drowned chalk measles distort antibodies vomiting occupying evasion promo electr blueprint
alleviate nostalgia cavalry torped sank goalt noteworthy inefficient distinctly openness gossip petroleum avatar caves safeguard subconscious piles
avoids bleak insanity twists faulty piracy impover rugged sands natives hen greens freezer dynasty archaeological blockade allerg debit willingly
disproportionate oppressive diamonds belongings bells imperialism exploding rant nominations peacefully vibration ropes bri discs prominently vulgar
skipping tsunami faults detector bastard validated unsur affirmed fascism resolving detract rigged homage presses humour spacing liquidity slug
scenery constrained goalie taxed fetus reconstruct extremes concluding deductions groundbreaking moons electromagnetic amidst commute fluctuations
noodles pipelines scars visc jumper cognition assassin witnessing lac adject glitter calf spoilers succeeds chanting slogans mornings lineage sip
intensely flourish tumors procurement raided deliveries shutter cerebral bipolar debating eagle eman comparatively lex fertile depressing superficial
prominence mocking psychiatrist noisy slapped para nour messenger teamed literacy emitted evade maze wrongly stereotype pledges aroma acre breweries
coer undermined blaze famine desperation attendant respondent boun paved unexpl confronting stalk vener resilience abandoning gradient expansive fung
bounced precautions clarification dagger grips hostages compliant alumni cybersecurity invariably lawmaker ale customization spared discontinued
computational supremacist paradise catalyst unrealistic maple aids winger geared jihadists steroids linger immersive outweigh transforms referral
oddly lions lyn mound competence withheld ostensibly msg denomin plunged pamph downright fading ove battled seafood figur squads interviewing aspiring
clauses luggage hose systemd descending fug uter voyage ace volcanic womb beginner detecting breaches restrained rulings humane assaulting vigorous
intolerance dummy separates intuition disdain condemning generosity panties specifying crystall rupt profiling sideline obligated occult bureaucratic
insiders substituted builders stationary doubtful vigorously thrilling borrowers satir insurgents isot starred tipping cavity goof emphasizes regrett
novelty envy indifferent adip breakout hurried roaming marginalized edits specimen vertically audition caster deflect versatility airing spectators
declarations onwards nets politic portraits pavement saints beginners shortcomings comet hospitalized peel readable muzzle benchmarks overload immoral
fries reproduced formulation coached uncond progressives wreckage brushed zoning karma trader seeming tunes indoors nob peppers oversees raft
textbooks inconvenience implicitly boosts sensational greedy inexper tighten ancestor sap grandson fracture moderator estimation parach barric compass
allergic wagon zinc rubbed liar selector troop guts routines summarized tranqu gmaxwell apprehens poems sausage themed lounge charger spilled disqual
helper horrifying ail holog atten upro counselor toxins banners greeting frenzy allocate consolidation scholarly egreg insecure victorious singled
elves camoufl conditioned compulsory podcasts neoliberal trusts insured sabotage lodged seventy whisper mating angered collisions extraordinarily
coercion permissible pointers dissip theatrical forgetting finalized booming precipitation integrating chrome intestinal matchups blockbuster
preaching authoritative dishon chatting recreate delinqu broth scholarships blended alarmed blends hepat persecut sweetness forfeiture insignificant
seaw emblem seriousness parsing substitution pressured recycled proficiency mantle practitioner condo utilization nausea formulas challenger defective
yogurt distributor scrolls extracts viability exposes starvation closures complementary monet articulate scrim prostitutes severed attachments cooled
policeman prayed clut cath anomaly exposures opaque disguised pots frowned poisonous crab treason ranc escalating warr mobs lamps spelled meats stomp
aloud bumper serotonin cultivate mosques reactive defenseman drowning thriller accelerating directs painfully productions gag whist sock infinitely
lieu candles heavenly pessim inference powd paints dazz inspir showers saint benign envisioned shroud shuff segreg revisit substrate eliminates
stamina constraint appropriated pes intellectuals restructuring runes delightful carbohydrates transporting ringing scarcely prototypes narrator
decidedly reuse forgiven seamless softer transient orbital fulfil dynamically pige veins soaring jihadist gamble careg inflated shocks splend
commenced fulfillment embodiments hail catcher volcano stabilize intensified humiliation heed abolished deem exceedingly doorway competed nationalists
groom disposable biod avid artificially advisors tedious trope decimal entrenched fraternity latitude enhances shines breadth capacities sexes
differentiation heavyweight migrate exhaustion guitars clones warranted salvage disks addicts amazingly impartial ridge blitz canned ironically
compassionate rallied quota completes shrug revise treacher quasi deposition confidentiality imbalance spanning angular sacked finely shitty
referencing classrooms sod crater roast influencing dup stature bathrooms hypert commencement moderately distributors breastfeeding messed blackmail
conversions scientifically mantra ivory pee linux submer doctrines attent prescribe encaps secretive capitalists briefed plunge safeguards oste
smoother footing motorists masculinity mism abdominal escapes sacrificing intimacy anterior motif graz visualization guitarist wards toilets teleport
hassle hob airborne spans chili aperture volunteered uninsured fuse erotic advertise attends smoot blond stronghold prosperous boasted pharmacy thumbs
motherboard guardians shack wisely backbone suicides designate cleansing vested stringent unsub summed characterization savvy fri misinformation
insulation corridors airplanes shun schema horrified rarity grouped sequencing radicals anyways reperc handlers hesitant campaigned simmer rods melody
convoy screened ultras antip fetish ridiculously mitochondrial interfering overfl acne petitions subscript sorce phon raced daytime engages miracles
memes hairs slippery caramel alk apologies outing countered firewall repealed wart subscriber begged semif preach revital punitive shortcuts
instituted abdomen superintendent fry contradictions landscapes clust volley tandem robes promoter eloqu fps prioritize mog precaution overlapping
jars cane physicist depiction slows commissioners technician homicides shader rever hardened whereabouts redevelop carbs travers squirrel follower
sings rabbits documenting misunderstood premie skating passports fists priesthood dungeons antis familiarity cram legalized cuisine fibre interstate
saddle github multiplier stirred customary billed multiplied flipping fundamentals tablespoon liberalism surn coined pragmatic trailers silhou probes
circus concession gastro gimm autobi wonderfully theorists sleek sul potassium lineman cereal mathematic astronomers fares chi youngsters mistakenly
hemisphere attracts playlist porch incorporates soak asserting fearing escalated robe inexpl lords cigars lubric narrowed murdering downstream
progresses establishments mixes hypoc sane dangerously circumvent celestial subpoena persisted primer synonymous nib notation forbid projectiles
fiercely guarding leveled condoms nightmares roommate hygiene lvl formatting revisions resurg indisp gown cis bystand importing locom showdown
responders takedown mattered predictive overlay conveyed defensively approving tiers demolished mono hospitality blah banker mosquit hust torment
standoff amplifier daemon mattress obscene compiling prank mourning sediment reacting translator bogus baptism sibling continents tolerant horribly
impatient defends anatomy drawer patriotic undisclosed farewell conco enthusiast inventor draconian commonplace citations unleash succumb reluctance
wiret combos charcoal driveway technicians magnesium slut growers borough chant compositions mildly meddling agility synth exclaimed contamin praising
manners bowling mandates reconcile portrayal cushion mitigation erased deficiencies bred pregnancies emph planners outper perpetrator motto admittedly
millisec combustion fabricated battered sidel knots surgeries courthouse mastered hovering safest bullied barrage veterin intel amnesty piled
honorable soaked coma instructors conceive easing caric shovel puff seamlessly acquisitions autistic mustard moreover copyrighted custod img federally
microbes overrun tornado adjud intrigued burglary serpent compel righteousness demonic mell derail noticeably unnoticed seq concede captivity stride
algae policemen astronaut depended ventures tits condom indent uploading mindful contends calibr sprite handheld semantics cleric christ invading enum
allege thru sailed emulate insecurity crou accommodations incompetent slips bye ard extras slaughtered crowdfunding filib enlist sergeant dissolve
standings beneficiary aquarium brightest beginnings rooftop preferable turnovers exiting jab acron endlessly brute trusting hots malaria json pounding
postponed unequiv cavern conservatism mileage arresting mixer authored proactive incarcerated peaked wielding exqu fret ethn archived imb countdown
awakening unnatural evils introductory ambiguity coloring stormed unanswered leve coy courageous confiscated unconventional moms discredit bureaucrats
bumps submarines sketches deceptive rampage muttered pupil fractured revert criterion repercussions flagged blames inverse makeshift devoid fossils
depleted woes lipid situ furnish shameful adversely adept remorse murderous redef prescriptions fres poultry harvesting cautioned evaluations
harassing bindings hitters adversary setback encrypt lows bulbs bottled spheres subtract sensations appalling environmentally publishes diligence
advises petrol imagining patrols nuanced lowers quitting basin docs civilized constructs withholding sanity grocer recounted spoiler logically
succeeding polymorph axes scor relaxation deterrent powerless lesbians chords separatists airspace turnaround cunning bombed tion withhold waged
comforting rag relocated strategically gamma grilled sensing renting sew improperly starving striving harvested playful avenues occupational wakes
drummer apparel hunted cocktails sizable hurdles eco fingerprints dispose inspected fuss ambush manifested suffice compensated genus hikes enrol
politely eyewitness uncomp posterior progressively indifference academia sewer astounding eldest climbs outcry contag pept chromosome scrambled
tremendously craving bundled injuring arcane topping paranoia egregious gravel bland parity sided formulated intrusion carrots moderation characterize
socioeconomic perk trustworthy embodied teasing absorbing unfinished disple professions angrily prevailed cartel vas retarded retract identifiable
arrivals shortened discrepancy kinderg remix connectors sugars sunshine psychedelic digitally shimmer shave crawling unfolding appropriation keyboards
overth laure totalitarian observes taps roar chars painter beacon downturn hinder utilizes senate ensemble cheers affluent gruesome wrench bourgeoisie
stained slime chests groundwater dudes paramed enqu devastation friendships spurred dossier overlooking fixtures curry squash catalogue abnormalities
digestive subordinate massac burgers downstairs lasers cyclist buffs raping recommending multicultural businessmen uneasy dispersed abstraction
printers analogous unfolded leveling breached nat translating antagonist fuzzy bewild signaled protester garner kay abducted stalking deserving
scratching tease missionary chemotherapy staunch coveted exited nerd vivo adherence chew weary guise binge manned illusions billionaires coloured
macros spac dictated shouts ripping analysed cheered arithmetic witches spoiled overhe administrations tint regiment pistols blankets epist bowls
hydraulic dean jung ascend unavoid stemming morbid deleting directives iterations patented precursor maiden nods ventilation wizards ominous lumber
ancestral wrestler yuan iceberg magically diversion harms marrying blending wrink humanoid whistleblower supplemental powerhouse perenn cubes sofa
intimidate extradition disabling memorandum bladder foreseeable barring slashed humility drilled sewage homepage courtyard vile subsidiaries ammon
percept grit fishermen cooperating melan enlightened ali salute weakest semen entertained penned coupon weakening underestimate shootout charismatic
prudent riches cortical strides drib euth simplistic impoverished augment intervened listens sage rubbish mull videot adaptations medically boarded
arrogance scrapped oppress junction subdu lett regained thugs dictates battleground condol accuses shri motivate reflections juicy restraining
appropriations slopes manslaughter workings trench gladly bullpen groove pretext transmitter underage bloss replicated liberated butterfly
fermentation youtube offend cessation insurgency bir hypotheses plaque jackets confer adapting shoved refine gon gunmen plethora puberty waterproof
athleticism capitalize illuminated irritation fax residing stumble adversaries smear arson scant monarchy halftime residue indign lobbyist diminishing
outbreaks goats sandbox navigating untrue ludicrous delaying implants journalistic smashing cruiser occupants pint hect stag gust brightly uphill
lesions biologist pertinent unmanned endanger replen tailor gadgets audible bombard defiance unaffected soared compromising vampires dipped sideways
habitats futile epilepsy coping concise tracing shaky uptake predatory intoxicated baseman sewing agony lodge punt erroneous mould anonymously
simulator streamed teased coefficient wartime fandom lia downhill interpreting jealousy pleasures receptions citrus complied realms irrigation
bicycles electronically aesthetics dunk reunited humid youthful entails mosquito coordinating flowed tackled fashioned reorgan reluctantly presumption
amenities morals clich welcomes standout dreadful bananas balloons suffix duly geopolitical acquitted scarcity mindfulness styling punishments numb
ascertain perpetrated disarm exponentially abolish grease persists infusion buddies demos acquaintance xml fascination overshadow roam speedy disciple
assurances mosquitoes numeric independents transitional reactionary shortest sequential breathtaking wardrobe enriched legalize freaking terrestrial
ledge southeastern slowdown retreated reins waivers alteration indefinite stimulating descriptive pneumonia laboratories malfunction homosexuals
turbines minded feats indispensable reel diverted likeness subscriptions fingert filthy perplex sweater steadfast athletics commend webpage forcefully
relocation satire informant bowel purge picnic objectively obliter loophole journeys omission sprayed guru traitor timet snapping bowed summarize
lender collapses antibody disband rover calam fences sque quotation troublesome levy nicknamed appe photographic corpus activating licensee
disparities freeing silicone spor correlations tuber wealthiest fooled daddy knockout insol bou dancers idiots tart cocoa sampled lookup injections
roadway genitals paralysis reap sloppy herbal incur ideologies backups toughness hive brigade revol taboo wedge infuri anomalies comprehension
empowering ire juices facilitated civilizations libertarians rune campaigners lace draining liner potency culinary enlightenment wearer mined ply
incest deval dart mul removable miscar merging brisk luxurious bitterness edible rectangle darkest hitch dosage scaven diarrhea enormously adamant
renovation cervical floats dex salty cape homophobic wandered tightening deserted facilitating emergencies exhaustive heartbeat presume surged dolls
chimpan ticks councillor pilgrimage insertion coarse contempor funn ramifications garments humorous nylon lurking misogyny taped grouping beads condu
grievances endpoint avenue shady careless brokers temperament uttered pedd improvised tabl plains pollut thwart pagan garn assortment unborn paralyzed
eruption intersect alloy underestimated mural busted nonex allergy hrs replacements activates pans longitudinal nuisance swell defiant sonic bisc
distressed chefs optics redesigned sightings contraction startled understandably sunglasses docker surfing shalt unrestricted tad rename educating
grinned shuffle saturation vodka foreground vehement turtles menace drip alarms pioneering chiefly thankfully evacuate civ divides berries sushi
plurality disadvantaged battalion cling undeniable haunt quantify differed videog quar bundles neuronal landslide renewables jerseys bunk robotics
emphasizing monumental tbsp rotten twisting goodwill immersion brushes phantom expansions embarked relegated muster withdrawing microscope buds
widened repayment hindsight watts survives flurry manageable tariff strikeouts cosmetics rethink overcoming woo distracting discord reassuring
consortium prompts indiscrim timeless pesticide rallying negligible turbine legitimately counterfeit unbeat unres scrambling amber royalties classify
unheard controversies enrichment platinum ecology untouched supervisors footh commons narcotics indices additionally caveat ration resin calibration
knocks compost sarcast kisses surrounds uncertainties crem upfront reciproc depressive mech annihil counterterrorism manuscripts hypnot prosecutions
divert taxing strands pouch nicer intimidated stricter microbial vows quake reinvent relinqu chewing localized acquainted fellows checkpoints
reelection mediated hurdle texting trustees dich distinctions usher parasites barbecue grapes assimil haunting firepower defamation compose allergies
strang brewers buoy obsessive braking clinically locale horsepower staffing futuristic damning weeds agile carve conducts lick riff scripture boiler
hamstring cataly faux scramble carc grappling pretended curated headphone deadlines horizontally ordained frig protector glare rift recapt inclination
imposes haste dolphins commuters extrap slender competitiveness cyan extravag elevate excludes sentient epoch alloc markedly knob adventurers
onslaught cottage fragrance relocate semin rocked articulated trustee scripting bunker crest arousal decode refunds wiping puzzled matte tainted
symbolism protestors lax attm sidx cider woven dstg sqor istg indulge disgusted compounded nem schooling proverb scarf rectangular hormonal marches
ordinances dusty strawberries perce amused fiat federation patriotism outlining blasting undermines clashed transitioning plugs hiatus mig integers
orbits blazing reimbursement sockets provisional ninja seizing salts dime faire totaling diagrams mythical kilograms elbows improv supremacists
regimen requisite unilateral hires involuntary transpl doubted falsehood airs fertilizer aquatic evenings pdf profitability gatherings ascent algebra
bios astronomy containment coronary heartbreaking psychotic equitable ozone cooker reopen infinity awaits bolst revered pods amplitude trousers halves
splendid preventive admon inverted hastily ledger astronomical circa dru travellers pane patiently aiding loos consumes bonding tilted menstrual
risking accredited skirm examiner messing nearing swapped goose lofty apocalypse bamboo tightened adolescence rainy vandalism conject cheated
moderators deceit theolog quirky needy mailbox bos enlarged badass pristine intervening laz projecting chatter examinations mystic leaps subsidized
firsthand coincide fools swollen expended spar keynote unequal progressing scripted earners larvae paramount camouflage binds mascot hairc twitch
concentrating nipples gir ponder weddings loneliness spree bribery racket champagne modifiers assemblies sulfur orbs esports lush hue spectral bushes
reinforcement reopened auxiliary vertex typh cull decon tossing disparate sund cozy hepatitis aval petertodd magnets brilliance derives hypertension
lambda flair missionaries rapes defy seismic eurozone scratched bows dripping frogs amplified diagnose crowned bursting dissolution usefulness
persecuted impulses spontaneously inconvenient dismissing plotted eighty sitcom clears opting enraged runoff rpm skewed hotter crumbling captains
reversing crocod mercenaries pacing cannons badges initialization biodiversity feudal disclaimer crow ignition adrenaline smelled impunity agendas
omega backer spins pauses shredded strapped scratches attire seminar continual abbrevi frantic unavoidable artery annotations dors unimagin resembled
barracks surrogate categorized vaccinated drainage indist reconnect emanc blindness altru abyss infused forestry mogul polled flap coax hither nailed
slashing retri departing midway ultrasound behaving stripping orchestrated lends raven oxidative favourable humiliating fidelity layered paycheck
servic slump reassure phyl oxidation prized mistress encode stupidity qualifies pulses froze urgently mailed sustaining basil puppies antim whispers
bravery tame parted indebted addr eminent ousted reviewer meltdown rearr stumbling batches contraceptive prostitute subtly contestants cartridges
blush reasoned dyn nightly semantic disagrees harming embraces strives inland heats hars skysc collaborators revolutions dismantle confidently kinetic
percentile extracting physicists fellowship dashed fue disrupting gland strand stadiums psychosis brilliantly submerged cages diluted archetype
relentlessly crippling arthritis admirable subtitle originating swore procession refurb immersed skeptics ceramic fir weave entrusted novelist ninety
disagreements backstory cheerful inexperienced rapist plateau cipher shaving murm contractual stewards physiology bumped fructose promul downfall
butcher bour contemplating modem genders maternity rocking handguns tumult vibrations repositories sans overdue overcrowd legislatures paternal
expressive distractions silenced biking propriet imposition conglomer trolling specials disemb treasury undesirable widening verbally infancy cutter
decriminal dysfunctional besie northeastern aust segregated traverse monastery plent pric collaborating recorder flats wrists bakery endings
precedence rollout boon rounding clad vap unsettling drifting recalling unfavorable dances legality inquire eyebrow panicked transformations revolves
onward liquids decomp prosecuting amphib blurred visceral collaborated apartheid brid preset poetic emulator honoring tractor sidewalks violin
generalized embargo fastball kicker additive escalate tweaked stash sparks convict blogging murderers depl dissect customizable atro outpost
glyphosate shove amulet exacerbated eater pulp unnecessarily visualize contextual tentative intermittent ridicule atheism pathogens reintrodu
flashlight swearing pengu rotated fashionable endorsing ingestion cooks teaser converter rapt shelling illuminate dentist whims parchment derog
unwitting cuc borderline upsetting recourse draped colder veterinary devout geometric circumference graft disadvantages hubs galleries groceries
rapists fungi parasite unse surgeons unethical layouts constants towels deterioration blinded onstage clans antique rhetorical traumat footnote
dimensional intrigue leases apprentices swoop bedrooms incapac manifestations amy positives usb skulls consolidate clen mummy finer reinforcements
gymn extortion hippocampus squarely modelling rushes ensued creeping oblivious jeopardy distinguishing begs sinks dancer magistrate disturbances
paraph mischief urinary ejected irritated denounce binaries oppos spew drifted annoyance boxer deceive condolences heals buckets slab sealing cardinal
milliseconds sterile outp exiled selfie manic nano resolves millennia explodes constellation adultery broadcasters kindergarten mute discreet
preschool preempt blocker wrought insurer quotas preached eviction seventeen folds dotted pizz soils novice stool detonated subdued tallest precarious
unquestion queens dominates backlog condensed acronym warmed misled ferment stares blacklist expulsion retweet troopers homers contingency undue
aroused pas morp floral administering compromises bitten materially dove windshield swapping flawless propulsion assigning fabrication barley towering
altercation tuna coolest palp hysteria spawning shrunk ecstasy applauded sweating redistributed popcorn seminal arsen spiked favoured encompasses
inspires burgeoning intending filibuster coworkers auditory muted lavish hierarchical crippled quiz archaeologists abandonment raspberry maneuvers
behaviours insure remod spaced affordability occupies necklace sedan abusers thorn populace repairing psyche modulation decorations apologise giveaway
authorised torpedo amassed opioids purposely erg correcting revoke freeway poking unlocking unfit ratified casualty sparkling concerted complying skim
hostilities muddy conspicuous rescind wearable eclips fallacy solves singers selectively clumsy purchaser benefiting yielding spinach delve exporting
grop envoy facet fluffy excerpts shorth reliant bathing globalization hoc orderly exchanging stout loopholes explor unmarried intellectually darn
leftover proofs indexes conductor behaved synerg millennium catering enslaved awakened deprecated dystop trembling dreaded unparalleled sensed fencing
scoff contemplate apprentice championed electors unsatisf qualifier deadliest ions accents tweaking shaved methamphetamine normalized choked scalp
semic confines restrain choking slang neurotrans empowerment climbers proficient scrimmage wallpaper resurgence antiv buffers subsystem eradicate
blatantly behaves antics php explorer revolving bask asynchronous sermon sizeof entrepreneurial platoon conferred patched fractures detects dedicate
constituent cosmos sweats sprung unsus bulky therapists totaled booze diseng motorcycles inventions lettuce spirituality unlucky tongues leans
invaders canopy veggies ejac jails fleets snippet electroly mutants rentals intertw creek carp contrasts reconnaissance unknow looting regulates
optimum roadside danced uncontroll favourites ceremonial vascular contemplated barren whisky carving undecided advantageous palms starch paddle
flaming probabilities exodus fungus dissenting fabrics soften ineligible estimating shedding breathed attaching analyse unsustainable interpol
protagonists formatted bum vanish transmitting murky awaited menacing ont munitions decency unthinkable presenter plank benz slamming vanity owl canv
blindly alternating sociology ops attribution abduction sidelined refining cautiously comma misunderstand dismal realistically patio exhausting
streamlined incompetence ethos incentiv gritty exponential correlate consensual conclusive ducks elong simul protr psychologically presumptive wil ppm
harbour coroner fraught casing runaway gin neuroscience borrower petitioner invoking sts childish antioxidant screenplay adventurous cornerstone
rookies originate electrodes scriptures glued discontent afflicted mosa entail vil preacher decorative prejudices rhythms strife rematch vetting
convened vacancy ruining racks heater cov recounts truce casinos crusade carnage stripe proclamation goodies topical specialize anchored bearings
mercenary interviewer embryo pci chuckled earthly dispers pals clandestine cannibal horrend echoing disclosing bribes intrusive gripping decoding
poets jaws deletion usur fortunately sanitation partisans touchscreen embryos amd prescribing conformity plentiful disillusion fanc assassinated
perennial stale cached las shards newfound darling rhy wellbeing unmist restroom timetable radios cloudy unchecked brazen leng diagonal deficient
omnip blender sunrise payout trailed imperialist slur trenches mirrored immortality contradicts geo canonical perfume orchestra uphe reigning caucuses
insulted rooting whore tofu rive watt persuasive observational trunc exquisite poop homeowner loaf clinging immutable fingertips initiating absentee
obscured dwarves multimedia brewed apex traveler boils spraying disapproval shadowy lamented unstoppable cohorts sluggish inscription inhuman plumbing
coupling sponge idols ticking loader stimulated sidebar praises migrated lecturer kettle glyc squeezing commemorate waterfront equivalents imitation
cunt voic bonded inhibitors endeavors occurrences impacting summoning bestowed opium reputable waive stalls demeanor fluoride longing plat grossly
bulls showcasing conceivable trimmed roadmap saliva trumpet miraculous colonization amput leased degrading baptized surname blinked pollen dermat
regex narrower hurricanes hallucinations attainment nominate avocado reverence euph crates shortstop propelled api oversaw coli overcl aluminium
democracies traffickers sped prod cac swirling saddened archaic excessively aerospace ignited handset reforming frustrations nostalgic feasibility
orbiting shin inconsistencies grazing detectors hog fortified codec improbable lookout tyres buildup audi grotesque glaciers incidental datasets
assembling drinkers qualifiers leash unfounded kickoff reconcil pioneers precept glossy satirical carrot diagnoses rendition pathology selects assay
textual interconnected erratic environmentalists engagements economical gearing favorably hanged ballpark beware inaccessible fray bitterly
irrespective endorsements undet merciless immature voucher inver shaman sarc groundwork amaz arbitrarily disqualified hugs spaceship unsuccessfully
nearer upbringing separatist racists chained abstinence reinstated symmetry reminders mont exemplary qualitative paed dispensaries complimentary
cryptographic maximal entropy combatants commuter slit chants squadron contrasting tidal libel implanted uproar propositions redevelopment measurable
imaginable apostles steroid specificity blister boasting tacit retribution dues cameo constitutionally widgets crappy anticipating hut bulletin chats
selves convergence nasal fullest ferocious lobbied soothing inspirational specializing insanely tarn melanch deployments lessen furry bloodshed heirs
alters approximation supermarkets bribe misinterpret thresholds gastrointestinal guideline deceived purportedly spacious superheroes thumbnail sheds
dams yawn caching oversized dogma communists freshwater wounding debacle youngster threaded illumination loosen momentarily astonished revolver
delusion relics adherent handmade combating quadru inhal unab scorn reinforcing adventurer doctoral engulfed lashes distilled granite smack parachute
camel forearm timestamp probing dormant boobs masturbation destroyer scatter receptive marketers launchers axle laborers mediation iod coincided
logistical culmination rodents lawfully reperto turrets incess curled preferring privatization irresist discriminated bartender propensity reinforces
eerie hugged filler engraved imaginative routers pierced curtains forecasting complains bible germ congen crane respectfully oval thirds moistur
tentacles colossal indoctr basal lantern provocation anguish initialize predic diploma sociop hammered glimps stacking fend unn strawberry cherished
inferred insensitive painstaking alienated acknowledgement vouchers moot cabbage latent disperse pandemonium virtuous seams titanium recollection cran
rites uterus skillet disenfranch ageing iterator discretionary primates dmg nursery annexation coils skiing peg timeframe mastermind stroll minimizing
illegitimate prototyp prematurely manuals aeros screenings debilitating fades definitively stagnant dissatisfaction kidneys cartels foreclosure
veterinarian fumble parap prick abound sharper previews communion phony newcomer redistribution lipstick tangled retrospective volunteering unveiling
senseless fisheries hinges calculus undefeated optimizations depress billboard legion penetrating humming condesc egalitarian devs republican hamb
transsexual skyrocket markup heroine successors downloadable indexed scaff racked unob resonate sparking outl handcuffed landmarks softened dazzling
untreated wrongful lured cortisol vex labyrinth hijacked superiors unearthed centrif shameless icing predictor agitated repr knitting fodder breakup
appalled antidepressants gulf doorstep misfortune bona degraded aversion supplemented deprive fragmented believable convertible powdered smoker
obedient bothering foregoing anarchism littered anecdotal fian behavioural sublime fruition corrosion likened besieged linemen vitality shortfall
pronunciation insightful charms bins ambassadors inhibitor soaking phased scams buzzing hesitated cliffs interruption underscores watering pastry
visionary piston antid pard waging nobility injecting retake cathedral wrestlers partnering noses bouts sep moratorium penchant offensively proxies
verbs persuasion multit scissors apocalyptic absurdity playbook autobiography sneaking rightfully niece linen pollutants paw reincarn silhouette
grooming valves penetrated overest exasper trickle bourbon wretched microscopic checklist adorned increments masse hordes arranging glean discredited
clinicians achieves principally frail thanking recl suppressing antidepressant thor spa kingdoms plung divest resurrected geological necessities
carniv milestones ker dismantling reprim crossings patriarchy blasphemy thence synagogue essentials wink peac malice flashback thw layoffs trooper
hinge audits unsuspecting broch apprehended disrespectful ascending throughput quarrel mills hemor irritating redeemed horny standby sleepy extrater
compliments installs banging metaphysical enthusiastically gripped comedic guerrilla decoration consultations unamb plagiar magician erection
telescopes unprotected stocked wastewater intimately spoof nefarious fins censor intersections lauded physi generously arisen glands uniformly ramps
routed limp vaping experimented sighting infiltrate signings elapsed spills domestically synchronization genomes locating kitten rinse grapple leasing
roses mislead perfected nudity nonpartisan nuances deductible galvan nobles eaves risked neurot underpin loft manifests synergy religiously hemorrh
tendon injure pag agitation esteem dodging ceases intakes inserts embold furnace handshake bruises effortlessly groin roofs estates haha densely
plastics incidentally chanted forceful hideous fundamentalist truthful lil downed enchanted params allowances turbulent complexities gigs patriarchal
calc cout pathological underrated fluorescent vehemently internship flakes reusable polluted circuitry planner frantically faithfully abnorm
disobedience skirts worsening scapego trove tracts organise ostr leveraging lang extermin contended encountering sweets cohesive repud lizard pilgrims
salesman ankles discrepancies unconditional secretion plaza ming depletion cytok batters coaster portraying wielded proponent ripple graphene flyer
recurrent devils waterfall tampering tavern underworld stump occupancy aber wellness negatives blight repertoire quer hapl mysteriously perish
restless dinners tragedies didnt ailments observable professionalism endemic pedals correlates sponsoring barb nonviolent homophobia biomass slay
brawl nonexistent portals tricked horrendous peeled manoeuv resumes accountant adversity hampered doping bearded watershed choir sculptures sneakers
confronts recal hairst humiliated polio complexes babe yells princes bullies pleasantly buf denote unpublished kneeling lapse referees puzzling
facilitates jewels booklet polarization grep vortex publicized festivities fleeting chromosomes busiest repealing metre goggles drawbacks complainant
authorizing antitrust mah exaggeration haze extinguished canyon vents scrape avg microbiota suggestive decipher declass tho decrypt brushing cpu
viewpoints crispy solder cassette identifiers smir township grieving boldly esche swirl negligent localization omit invitations moss anarchy childcare
lull usability diffuse sprites smugglers reformed unfl testers gadget bracelet paramedics jan lov flask overpower lodging absorbs pamphlet holistic
detachment aspire complicit respawn abhor mockery consec funky detriment degrade retard fragmentation cowboy optionally hunts executes acidic plunder
canine socialists impetus organisers documentaries resorts bragging hectares toxin faiths vec ardent tidy instinctively lich feral perverse warped
nineteen cabinets powering stren cog cafeteria raining circling linebackers repatri lyric descriptor valleys req backstage servings overseen asteroids
multim firefighter chlorine sparing polygamy tigers flashy prefrontal prerequisite wifi misconception harshly tubing rightful specialization
passionately latch helium dipping interpersonal subter biologists optic denim fearless alot neuron grading roaring monog appellate liaison spherical
perished blot benches pioneered hurled reefs elector uninstall impede blinking goto stabilization outlawed plantation yacht solvent gracious curiously
capacitor invocation prenatal deteriorating setbacks sig msec pricey overarching worldly scenic disliked artisan infield unresolved democrat sailor
rife tropes snatched obnoxious summers unexplained gull aerobic cramped susceptibility secession councillors nervously attractiveness stains overwhelm
trapping fide pts servicing overflowing chuckle queues anchors awoke divergence depot skew divul forks promoters levied pigment cylinders snatch
perpetually licking projector denotes chapel folly nurture coastline frivol phylogen hauled treasurer colonists inund resultant adjective rebirth
membranes forwarding collided stressing footwear scree anthology fluent bondage unrecogn undergrad forgiving responsibly mobilize effected kale
infringing fitt ruby exoner pelvic automate creed boredom regenerate comedians suspense neocons awoken shielding paramilitary multif goddamn befriend
insin psychiatry harb facade bluff favoring ranger evolves este drawback transformative propagation appendix stigmat holster ordinarily adhesive
gathers induces interchangeable trance incorporation awkwardly subjug nos fanatic irreversible lifestyles feds congratulate indistinguishable
commandments overe lobster wee stuffing warehouses pellets takeaway landfall settles fared glitches enchantment calculates leapt hypothesized rand
undercut retirees insidious finalists accuser wastes constituencies supper mayhem misplaced managerial exce primal preserves tripled approves
robberies gravy unveil gol fugitive accrued chicks stopp blockers commenters mayoral antennas revamped entrances tenets animate inconsistency ape
pearl actu payoff deities censored confounding reckon spotting signifies propel festive pledging rebellious overshadowed infiltrated scalable dominion
partitions supplementary hairy perpetuate nutshell curses quieter fueling capsules childbirth radiant malls inept spectator culminating vim sprang
pian feces banished heinous notebooks foundational marvelous withdrawals horde contagious pronouns morphine kosher fused pokemon tabloid repro dramas
bung pastors acrylic majorities fielding impractical swaps kan illustrating dismantled triumphant encompass bookmark predicate whence nonprofits
diabetic pend heartfelt interacts bombardment molten toured coefficients sandy populous contestant expr sincerity marqu elicit tacos postwar insofar
midterm signify obfusc aggro goofy briefings derogatory forging palate siph marginally flirt goaltender forbids clerks premiered magnification
preclude avalanche refinery endowed counselors dolphin armoured jams bandits homer seminars sql issuer chaired marrow limitless undrafted cohesion
necks footballer detectable unde shone budding thwarted ingenious fostering accelerator sunscreen tuberculosis substitutes inco diligently afar
fireplace headsets diffusion darkened sleeps setups parsed mammoth hearty conson galactic plummeted pests swat referrals underdog timid piety surging
desks warships arming tyrann caravan healer negate critiques outsourcing upbeat hangar cruising subtitles squared bookstore revolutionaries despise
carts honorary triangles reprinted graceful disruptions drains consulate bends mafia renal inaction photons bruised nests freezes cumbers legions
handwriting grun moth motel dexter prope lashed continuum deems repressive baffled crave entrepreneurship vines ascended dogged unimaginable
relativity assassins dissatisfied conduit scares protracted twenties predicament handcuffs fruitful attest biologically renovations unilaterally
cumbersome trendy rotting scraps facets radial wildfire waitress chops bluntly patrolling scathing deteriorated depictions authenticated promulg
rehabilit glacier vomit fermented graded shrew legalizing allotted oily inducing amygdala admins schematic moan tink merry butterflies workspace
javascript padded estranged smokes capitals entitle centerpiece thereto arcs obligatory hardships autos apes intoxication goblin spawns showcased
resorted whipping imitate digestion yea regretted broccoli postings accumulating needless mayors scrib anecdotes botched devise pudding garg evoke
detox metast tending foliage mentors minimalist ingested eroded blurry buffet ventured thinly arra theorem smartest decap adjunct redacted prehistoric
explanatory universes sensit paced fuller recomb pooled ana bulldo wrecked portrays guesses consequential transgress trivia grasping practicable hoop
unintentionally ignite colourful manpower emoji sophistication underscore practise blob automobiles parting remembrance eased covari dissemination
invis worsened legislator dealership investigates cascade bidder presiding ding contradicted shuts sinful totality restitution clueless nutrit
landowners flushed broaden println nig proto storylines evangelicals rotor begg weaving downwards esoteric furiously foreigner calming bunny upscale
chloride underside vape memos stabilized techno anew collegiate frontline ammonia appellant olds slurs empires buckle alienation unicorn overriding
despised hallmark stemmed principals cheesy clipping berth buffalo presided vets cloves illiter resistor brun whats denouncing souven caregivers
trough taxis tabletop hitherto disinformation complicate palpable ausp showcases retrieval refute inquired negativity conserve afterlife presupp
perpend spilling hypers flattened inscribed facult unprepared satisfies pulmonary infiltration externally congratulations airliner flung flyers
snippets recursive mastering overtly luckily encro sow squid narration naughty shatter purposefully itiner shielded redirected labou diapers cellar
undone millionaire cords sequels lewd slaying complication intermediary consolation fixme culminated conduc positional greets thinker ingenuity
freshmen dwindling tmp sten neighbourhoods classmate leftists climates sag hopped gasped moniker uncanny transports railways appliance unbearable
dorsal hypocritical gubernatorial juxtap chopping lightsaber herpes deserts situational textile contraceptives bere analogue takeoff majestic
commuting gorilla acquaintances spiritually eyed translucent nighttime marines hors kins reeling clutter avert encyclopedia exposition stockpile
clothed treacherous frying restraints embodies negotiators passers shorten innumerable suitcase wasteful indecent residences selfies cultivating
garrison nascent irresistible awfully equate anthropology intestine innocuous appraisal docking pont asbestos collagen hybrids invoice inequalities
lucid witty bruising licences jammed leth distinguishes beetle twilight booths excavation philosophies unforgettable verifying subordinates neb dumps
poignant mages liberate circumcised storefront explorers pineapple amalg ovarian haircut pav chilled styled dab ministerial sulph educator qui
heaviest grasped crooked predetermined maniac breaths hobbies charisma leaping kittens halting swallowing eighteenth particulars benevolent rundown
civilisation john peanuts flavored roared cutoff ornament architectures provoking rationality justifies dispel americ envis detractors conducive
transmissions alluded obe dope wavelengths attentive mang accol crawled flourished widen wig misconceptions venerable payday veiled everlasting hating
grinning geographically weeping impecc bloated persever aur pitfalls predominant farmland violet inflicting homebrew undertook curly tempered
harrowing predictably backfield genomic boutique batted gamb afloat endif winters scattering tru nexus airflow optimizing ecstatic clout subscribed
rehearsal amps sprinkle assailant retina nuns jug bikini restores ashore approvals signalling rebuke flares downtime stagnation grunt assures intraven
slams cultured creditor cloaked cheaply suites deliberations honoured edged migrating shorthand crotch calves strikers repentance arteries
cryptography intertwined docks allele opacity nipple handwritten trillions descendant ceilings nont miscarriage rigs ministries elaborated delusional
blackout subdiv linkage chronological resettlement pastoral bellig semblance curtail clinch pursuits flips coupons cloning pious depreciation pinnacle
seeker unfolds extravagant upholding bloodstream limbo exhibiting habitual delinquent burner contemporaries gimmick nozzle invincible wasteland rite
curing mats adjourn fearsome propell conflicted insurgent coales southwestern dissu boxed gardening purified placeholder dan ect caul aft adjusts
mammal stereotypical attic awarding catchy certify ital tides curator rgb wipes summarizes whistleblowers crochet repet crimson retreating dusk arenas
curv chores mammalian learners glamorous furthe narrated disorderly understatement rejoice electrode worshipped idi popup deft funk normative goblins
cafes sclerosis psi widest looms justifying flourishing rave ful yak arte valiant succinct quickest spitting snowball predis outage nesting notoriety
fou fatig hugging bothers volts feeble manufactures grizz subsections sequest mismatch morphology fortnight apostle tanker plush attendants vacated
uptick renovated lousy adapters affirmation ponies lighthouse adherents plaster dearly shaming subreddits pigeon lum pessimistic apologised gloomy
breaker deepen theorist baker staples interfered formulate vaccinations banter outfielder narrowing proclaiming posit prett lifeless orcs kindred
millennial granddaughter pickups expel jargon polarized rebutt apprehension prism ghetto boulder reimb sterling aggregation airstrike deflation
advisable workaround pid typo alum captives alcoholism recite gaping baskets corrective filament deepening buggy tenancy tuple forfeit meticulously
apopt mindless digs blinding reborn collide apr sleeper alternatively antiquity abuser assorted salon bustling waiter presets reptiles hashes failings
folklore abl periphery reckoned reservoirs dives vividly eclectic bystanders criminally nanop parentheses outnumbered counterproductive synaptic hiber
debunked exalted thrott billboards doesnt sling emptied endot babys ridden beetles illuminating fictitious shepherd molded delim organising hoops
fuckin decad unbiased smuggled kios snowy scraping droid pasture franc hysterical mobilization spearheaded embroiled conjecture paperback recovers
sweeps headlights concoct unmarked richness dissertation seasoning gib disembark mesmer fireball sled reused wrestle gunshots cannabinoids rejuven
gore rupture breaching spears aborted felon causation prepaid pitted willfully wob fateful spirited hegemony boycot timelines motivating pedigree chau
upheaval sentimental sax electing commenter enshr signage deline phosphate fors english tantal autoimmune defences tranquil ploy flavours microphones
iii headlined primed hoard triangular capit lash convol colonel pubs assigns contaminants robbers hotline fmt unequivocally pancakes oats subcommittee
sourcing sizing moderates bil exhilar snug despicable sarcastic latex tamp governs endeavour worsen scanners deviations sorcerer endogenous emulation
bould restricts mosaic melodies disson broom nerds mete crept girlfriends ushered insomnia gestation thirsty faculties nuance preferential starve wik
unaccompanied hopping caveats alas ibn gul robbing mitigating aptly tyrant midday phenotype ebook chic residues lyr perpendicular synchronized
refreshed adore pies unwelcome aliases campaigner advancements starved sizeable suspensions teaspoons coercive latt braces vending negro shampoo
superhuman ridiculed holiest interns hone dangling revocation dow iso outings inaccur outlandish anus unregulated succumbed cuff substr coffers
automakers jarring fumes disbanded strikingly spores orally tumultuous displeasure cones appease derby poked originals rabbi proverbial postpone
staffed diligent ponds mmol clenched caricature cellul texted retracted upkeep workplaces amplify multic convoluted snail saline insurrection
rudimentary transformer coincides shotguns proletarian scorp slander embell apologizing allot whine victimized nurturing flavorful directional clasp
surges canoe defied tripod gasp entangled havens stricken delusions bis gratification enticing impedance dred concurrently superpower pree
denomination inciting suspending mountainous refinement waterways diner initials rog paranormal irrad refill differentiated chirop excise cabal rye
resize budgetary apiece precincts peach skyline deform counteract nodding populism hep counselling undeniably railing sweaty banquet inventive
astronomer rusher centrist subclass disav defund pacif mend numbering laughable meticulous congratulated swayed semifinals humankind voicing thug
pornographic moaning grievance confessions relegation riddled ogre salads industrialized beck appointing pores biochemical cowardly biotech brewer
intensify instantaneous paving landfill dads incendiary chimpanzees pall achievable intangible ballet bailed turbulence occupant statically onlook
velvet dehydration acquies incomprehensible backdoor maths heresy pancreat solicitation circadian foray cryptic quarry resists snapshots bestselling
antic immobil nifty fentanyl darts stances sorcery perjury fiance nab humanities consultancy remission confid improvis unwillingness portfolios
claimants indemn evaluates rusty bedrock manipulative willful relapse extant poppy knack insulated untold converge refuel distortions ravaged
mechanically taco rake melancholy illustrious pageant wiser chemist plutonium tirelessly infertility uncontrolled innovate savior swast rink cardio
vantage vans propagate methodological triglycer ingrained decisively boosters desserts testifying lockdown hikers conscientious clerics relayed quartz
welding tumble subcontract terminating leakage registrations comrade clipboard discouraging empath footprints clubhouse encamp watered complexion
sects renters bras infographic locality flora populate subsistence auctions titan manifold calibrated caliphate condone piling embody vying principled
quirks crib timers glide smelling unsu condos bicycl juggling nutritious integrates adjoining uber whiff bilingual touting infall regulars pseudonym
exhibitions blaster reverber reciprocal itching emitting birthplace taunt circled deforestation overtake nun accompanies northwestern reassured
sporadic medial cannabinoid barbaric epis unsolved acknowledgment kitchens photon diaper brist blu instructional discriminating tyre aspiration detach
physique racer complicity interrupts utilitarian spaghetti porous esteemed inciner espresso mathematician overheard quizz flattering conn attaches tcp
foothold clutching teleportation reversible liberating asphalt wildfires technologically emits irregularities cherish stink coughing renegoti inquest
exerted perilous obscurity assassinate aboriginal rescuing jog viewership additives maximizing streaks tert colonialism burying worrisome vocational
sails tul familial vetted crammed percussion oranges roundup unintentional glutamate leaflets functionally caloric shenan repaid bashing
collaborations unaccount teamwork piping minced diam mascara sucker perv aromatic lockout seeded snag grounding reliever frivolous microbiome
multiplication coerced exorc staggered inertia gob classy transporter matured hijab biome extermination narcissistic whispering disinfect deducted
partake downgrade democratically limestone exempted fledgling virginity restrooms objectionable secondly postage communicates addon slumped majesty
viz unconsciously flowering manure disingen inhibited headquartered enigmatic redress rattled diction fascists coasts mistrust grate vowel unmatched
bordering contiguous distraught anatomical resusc abiding vacancies hypothal witchcraft acupuncture tex juveniles heroism doubtless bitters compulsion
millionaires intrinsically bolstered tutor indignation fracturing vacations booted soar glances creatively solicitor hawk superflu bombshell brokerage
raiding french angled unwittingly tallied biomedical euphem brainstorm modesty starship powerfully perl fisherman meshes etched toppled mysql recomp
derailed dehuman exclaim balk pegged astroph rigging fixation catapult loudspe almonds unbeaten rosters ellipt melts ratification multiplying
interoper ascert quarantine slideshow centimeters synopsis spate nominating throb generational unlawfully eyeing brunt interstellar clitor genesis
mutated disapprove squats levers transact shattering arsenic analges tactile prophes diced incrim dips crucifix simulac recycle renaissance plaus dag
intruder sneaky courier emancipation playthrough unbelievably stitching shenanigans vitri individuality barking mars tir slapping disgruntled captcha
angst joyful whining phosphorus attrition zipper relat cropped raged offsets mortals dismissive throats chipset chilly stoked fiasco bleach brav inoc
leukemia eluc announcer pepp vanishing redundancy prophetic habitable faintly flanked spurious shading motivational excruciating baths demoral
unification sacrament priceless gelatin emanating outburst eras rebate creeps pesky challengers entrants embattled defunct poisons traveller
ransomware cradle antioxidants salient allocations mashed pounded fanbase casc analytic vanquished crabs transistor annexed faked hindered
correctional inappropriately trespass paws negotiator elegance vigilance castles emphatically animosity psychiatrists incite maize interacted
transitioned parasitic harmonic decaying baseless transpired abundantly treadmill sshd frontman midrange perched overboard deterrence sill sinners
unworthy strengthens slicing malnutrition filmmaking wetlands allowable steered mustache mids clipped circulate brittle wealthier overwrite
overpowered acutely pim vigilante resided remnant emptiness outpatient leptin creatine hatched mango orthodoxy topple adoptive helpers chronically
accommodating wrinkles dodged precon compressor evict modernization bandwagon refuted netted fielded dere trout nihil happiest floppy unison lug
fuelled secretaries pomp detainee plantations towed sheltered lair etiquette soluble intolerable uninterrupted tooltip interrogated gunned tether
crumble clustered dystopian joystick overcame minimized torches rapport kcal curls bearer cynicism abras debugger debtor exacerbate branching salsa
mishand anecdote agreeable inhibits hashing solidly aspirin streetcar flashbacks ooz curfew calmed participates nonsensical fullback metabolites
looted vetoed gcc stiffness lowly unforeseen anesthesia reconstructed inexplicable hardness woodland metaphors rewriting perceptual unsurprisingly
tagging litres bounces overdoses bolted uniqueness epigen reckoning pharmacies rabid weep behest whirlwind utopian kidnap livestream subversive
assailants sprinkled laced itch ported logger embryonic delegated centrally hereditary prohibitions unrem laureate denominations insur fielder
patronage contrasted condemns composing heterogeneity ideologically fishes cursing stunts bead stocking hump parcels samurai actresses striped neutron
aph responsiveness sly webcam namesake unorthodox funer enclave homegrown conceptions reiterate meager installments photoc invests tragically concedes
visitation idiosyncr fractions foreskin poaching stimulates inspecting grandma partying testimonies pressuring fid hereafter dissidents solitude lobe
indis credential wills totem embassies bottleneck bount typew brim passively bounded criminality biomark dispatcher ultraviolet chemically
formulations annihilation unloaded morphed conquering thefts frontrunner shockingly composure grids debian furthermore dexterity massacres briefs
flared claimant cures giveaways cringe aristocracy glared radiator herds countering charred warheads iodine departures dyed quotations gist antigen
paternity ardu overloaded waning rodent dwellings bullish retaliate migraine donkey marquee willpower impossibility cleaners sorely flickering dunno
dysph mainline ptr retrieving duplication relational quaint biscuits ado shudder antidote sauces reinvest dispensary insepar toddlers lackluster aback
toolbar oust contemplation guaranteeing collaborator gou mobilized brood refin warranties swath caches antagonists hotly scourge conspiring buttocks
volleyball shrouded scoreboard asses deregulation kernels orphans calendars brunch sensibilities reclaimed interestingly rappers gazing snipers
reverted conglomerate harsher desolate amplification regress informants gazed
""".split()
